"""Statements that run detached: SUBMIT, CANCEL JOB, the jobs table, job_result('id')."""
