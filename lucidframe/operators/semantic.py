"""The semantic operators: filter, pre-filter, calibration, classify, rank, cluster, distinct, extract.

A model sees each distinct text once; its answers are stored before rows use them, and rows meet them by ordinary joins. A
row whose call fails gets the operator's failure value; the query goes on.
"""

from __future__ import annotations

import functools
import json
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lucidframe.errors import SemanticError
from lucidframe.functions.columns import doc_hash, fnv1a64, hex16
from lucidframe.model.base import Request, json_object, score_of, yes_or_no
from lucidframe.operators.context import Semantic, Verdicts, ask
from lucidframe.operators.index import FETCH, FLOOR, SEPARATOR, Index, doc_vectors, evidence, search
from lucidframe.operators.types import Field, SemanticType, unit_key

SAMPLE = 64
PER_MISS = 4
MEANS, CLASSIFY, RELEVANCE, CLUSTER, EXTRACT = "means-v2", "classify-v1", "relevance-v1", "cluster-v1", "extract-v1"
SIMILARITY = 0.9
CENTRAL = 5
PREFIX = 4096  # vectors that the driver groups at a time, and representatives that are sent to tasks at a time


def _means_request(condition: str, excerpts: bool = False):
    what = "excerpts of a document, which may leave parts out" if excerpts else "a document"
    text = f"You are given {what}. Does it satisfy the condition? Answer with one word, yes or no.\nCondition: {condition}\n"
    return lambda t, _: Request(text, t, 8)


def _verdict(answer: str) -> str | None:
    v = yes_or_no(answer)
    return None if v is None else str(v).lower()


def _hashed(df: DataFrame, text: Column) -> tuple[DataFrame, str]:
    h = f"__h_{uuid.uuid4().hex[:8]}"
    return df.withColumn(h, doc_hash(text.cast("string"))).withColumn(h, F.when(text.isNotNull(), F.col(h))), h


def _requests(df: DataFrame, text: Column, h: str) -> DataFrame:
    return df.where(text.isNotNull()).select(F.col(h).alias("h"), text.cast("string").alias("input")).dropDuplicates(["h"])


def _decided(ctx: Semantic, requests: DataFrame, condition: str, excerpts: bool = False, counter: str = "model_calls") -> DataFrame:
    """h, value of a yes/no condition for requests (h, input): from the store, else asked and stored."""
    store = Verdicts(ctx)
    known, misses = _known(ctx, store, condition, "means", MEANS, requests)
    answers = ask(ctx, misses, _means_request(condition, excerpts), _verdict, name="means")
    asked, failed = _counted(answers)
    ctx.counters[counter] += asked
    ctx.counters["rows_dropped"] += failed
    usable = answers.where("value is not null")
    store.add(condition, "means", MEANS, usable, asked)
    return known.unionByName(usable)


def _known(ctx: Semantic, store: Verdicts, kind: str, what: str, version: str, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(h, value) that the store has for requests, and the requests that it lacks."""
    known = store.read(kind, what, version, requests)
    if not store.has(kind, what, version):
        return known, requests
    known = ctx.stored(known, "known")
    ctx.counters["cache_hits"] += known.count()
    return known, requests.join(known, "h", "left_anti")


def _counted(answers: DataFrame) -> tuple[int, int]:
    """Stored answers, and how many of them have no usable value."""
    return tuple(answers.agg(F.count(F.lit(1)), F.count_if(F.col("value").isNull())).first())


def sem_filter(ctx: Semantic, df: DataFrame, text: Column, condition: str, index: Index | None = None, recall: float | None = None) -> DataFrame:
    """Rows whose text satisfies the condition. With an index, only texts with near chunks or unknown to it are asked."""
    ctx.planned(f"SemanticFilter [{condition}]" + (f" <- IndexScan {index.table}({index.column})" + (f" recall >= {recall:g}" if recall else f" floor {FLOOR:g}") if index else ""))
    if ctx.dry:
        return df
    rows, h = _hashed(df, text)
    asked = _requests(rows, text, h)
    if index is None:
        passed = _decided(ctx, asked, condition).where("value = 'true'").select("h")
        return rows.join(passed, rows[h] == passed["h"], "left_semi").drop(h)
    if recall is None:
        hits, labels = evidence(search(ctx, index, condition, fetch=None)), None
    else:
        everything = search(ctx, index, condition, fetch=None, floor=None)
        floor, labels = calibrate(ctx, asked, condition, index, everything, recall)
        hits = evidence(everything.where(F.col("score") >= floor))
    hits = ctx.stored(hits, "evidence")
    members = index.members(ctx)
    near = asked.join(hits, "h").select("h", "input", F.col("excerpts"), doc_hash(F.col("excerpts")).alias("e"))
    unknown = asked.join(members, "h", "left_anti")
    near, unknown = ctx.stored(near, "near"), ctx.stored(unknown, "unknown")
    n_near, n_unknown, n = near.count(), unknown.count(), asked.count()
    ctx.counters.update({"index_hits": n_near, "passthrough_rows": n_unknown, "rows_pruned": n - n_near - n_unknown})
    on_excerpts = _decided(ctx, near.select(F.col("e").alias("h"), F.col("excerpts").alias("input")).dropDuplicates(["h"]), condition, True)
    passed = near.join(on_excerpts.where("value = 'true'").select(F.col("h").alias("e")), "e", "left_semi").select("h")
    if labels is not None:  # a verdict on the whole text stands
        passed = passed.join(labels, "h", "left_anti").unionByName(labels.where("value = 'true'").select("h"))
    passed = passed.unionByName(_decided(ctx, unknown, condition).where("value = 'true'").select("h"))
    return rows.join(passed, rows[h] == passed["h"], "left_semi").drop(h)


def threshold_for(target: float, scored: list[float], unindexed: int, lost: int, floor: float = FLOOR) -> tuple[float, float]:
    """Score threshold that keeps the target share of positives, and the recall it is estimated to have."""
    total = len(scored) + unindexed + lost
    if not total:
        return floor, 1.0
    needed = max(0, math.ceil(target * total - 1e-9) - unindexed)
    order = sorted(scored, reverse=True)
    if needed == 0 or not order:
        threshold = floor
    else:
        threshold = order[min(needed, len(order)) - 1]
    return threshold, (sum(s >= threshold for s in order) + unindexed) / total


def positives_for(target: float) -> float:
    """Positives that a sample needs for the target share: PER_MISS for each share that may be missed; no number is enough for all."""
    return math.inf if target >= 1 else math.ceil(PER_MISS / (1 - target) - 1e-9)


def calibrate(ctx: Semantic, asked: DataFrame, condition: str, index: Index, hits: DataFrame, target: float) -> tuple[float, DataFrame]:
    """The threshold from a labelled sample, and its labels (h, value).

    The sample is the texts of the least hashes: SAMPLE at first, then four times as many until enough of them are positive or all are labelled.
    """
    texts = asked.count()
    size = SAMPLE if target < 1 else max(SAMPLE, texts)
    while True:
        sample = ctx.stored(asked.orderBy("h").limit(size) if size < texts else asked, "sample")
        decided = ctx.stored(_decided(ctx, sample, condition, counter="calibration_model_calls"), "labels")
        labels = decided.where("value = 'true'").select("h")
        if size >= texts or labels.count() >= positives_for(target):
            break
        size *= 4
    ctx.counters["calibration_sampled_rows"] += sample.count()
    best = hits.groupBy("h").agg(F.max("score").alias("score"))
    rows = labels.join(best, "h", "left").join(index.members(ctx).withColumn("member", F.lit(True)), "h", "left").groupBy("score", "member").count().collect()
    scored = [r.score for r in rows if r.score is not None for _ in range(r["count"])]
    lost = sum(r["count"] for r in rows if r.score is None and r.member)
    unindexed = sum(r["count"] for r in rows if r.score is None and not r.member)
    threshold, ctx.counters["estimated_recall"] = threshold_for(target, scored, unindexed, lost)
    return threshold, decided.select("h", "value")


def sem_classify(ctx: Semantic, df: DataFrame, text: Column, conditions: list[str], names: list[str], guard: Column | None = None) -> DataFrame:
    """df with a boolean column for each condition; one call asks all that are not known of a text.

    False where the guard isn't true or the text is null; null where the answer failed.
    """
    conditions_once = list(dict.fromkeys(conditions))
    ctx.planned(f"SemanticClassify {conditions_once}")
    if ctx.dry:
        return df.withColumns({n: F.lit(None).cast("boolean") for n in names})
    on = text.isNotNull() if guard is None else text.isNotNull() & F.coalesce(guard, F.lit(False))
    rows, h = _hashed(df, text)
    rows = rows.withColumn(f"{h}on", on)
    requests = _requests(rows.where(f"`{h}on`"), text, h)
    store = Verdicts(ctx)
    known = requests
    for i, cond in enumerate(conditions_once):
        one = store.read(cond, "means", MEANS, requests).select("h", F.col("value").alias(f"s{i}"))
        many = store.read(cond, "means", CLASSIFY, requests).select("h", F.col("value").alias(f"m{i}"))
        known = known.join(one, "h", "left").join(many, "h", "left").withColumn(f"k{i}", F.coalesce(f"s{i}", f"m{i}")).drop(f"s{i}", f"m{i}")
    n = len(conditions_once)
    known = ctx.stored(known.withColumn("pending", F.filter(F.array(*[F.when(F.col(f"k{i}").isNull(), F.lit(i)) for i in range(n)]), lambda x: x.isNotNull())), "classify-known")
    ctx.counters["cache_hits"] += known.select(F.coalesce(F.sum(F.lit(n) - F.size("pending")), F.lit(0))).first()[0]
    ctx.counters["rows_gated"] += rows.where(text.isNotNull() & ~F.col(f"{h}on")).count()

    def build(t: str, pending) -> Request:
        asked = [conditions_once[i] for i in pending]
        if len(asked) == 1:
            return _means_request(asked[0])(t, None)
        keys = {f"c{k}": {"type": "boolean", "description": cond} for k, cond in enumerate(asked)}
        listed = "\n".join(f"c{k}: {cond}" for k, cond in enumerate(asked))
        text = f"For each condition say whether the document satisfies it; any number may hold. Answer with a JSON object of booleans.\n{listed}\n"
        return Request(text, t, 128, {"type": "object", "properties": keys, "required": list(keys), "additionalProperties": False})

    def parse(answer: str) -> str | None:
        v = yes_or_no(answer)
        if v is not None:
            return json.dumps({"c0": v})
        found = json_object(answer)
        return None if found is None else json.dumps({k: x for k, x in found.items() if isinstance(x, bool)})

    answers = ask(ctx, known.where(F.size("pending") > 0), build, parse, "pending", "classify")
    calls, failed = _counted(answers)
    ctx.counters.update({"model_calls": calls, "rows_failed": failed})
    given = F.from_json("value", "map<string,boolean>")
    both = known.join(answers.withColumn("given", given).drop("value"), "h", "left")
    place = lambda i: F.element_at("given", F.concat(F.lit("c"), (F.array_position("pending", i) - 1).cast("string")))
    new = ctx.stored(both.select("h", "pending", *[F.when(F.array_contains("pending", i), F.when(F.col("given").isNotNull(), place(i))).alias(f"n{i}") for i in range(n)], *[f"k{i}" for i in range(n)]), "classified")
    for i, cond in enumerate(conditions_once):
        fresh = new.where(F.col(f"n{i}").isNotNull()).select("h", F.size("pending").alias("p"), F.col(f"n{i}").cast("string").alias("value"))
        store.add(cond, "means", MEANS, fresh.where("p = 1"), calls)
        store.add(cond, "means", CLASSIFY, fresh.where("p > 1"), calls)
    ctx.counters["branches_failed"] += new.select(*[F.coalesce(F.sum((F.array_contains("pending", i) & F.col(f"n{i}").isNull()).cast("int")), F.lit(0)).alias(f"b{i}") for i in range(n)]).select(sum(F.col(f"b{i}") for i in range(n))).first()[0]
    verdicts = new.select(F.col("h").alias(f"{h}v"), *[F.coalesce(F.col(f"k{i}").cast("boolean"), F.col(f"n{i}")).alias(f"{h}c{i}") for i in range(n)])
    out = rows.join(verdicts, F.col(h) == F.col(f"{h}v"), "left")
    out = out.withColumns({name: F.when(F.col(f"{h}on"), F.col(f"{h}c{conditions_once.index(cond)}")).otherwise(F.lit(False)) for name, cond in zip(names, conditions)})
    return out.drop(h, f"{h}on", f"{h}v", *[f"{h}c{i}" for i in range(n)])


def sem_rank(ctx: Semantic, df: DataFrame, text: Column, query: str, index: Index, name: str = "score") -> DataFrame:
    """Rows whose text the index has, with the model's score in [0, 1] of its nearest excerpts; null where it failed."""
    ctx.planned(f"SemanticRank [{query}] every indexed text of the rows is scored")
    if ctx.dry:
        return df.withColumn(name, F.lit(None).cast("double"))
    rows, h = _hashed(df, text)
    there = rows.select(F.col(h).alias("h")).where("h is not null").distinct()
    best = ctx.stored(evidence(search(ctx, index, query, fetch=None, floor=None).join(there, "h", "left_semi")).select("h", "excerpts"), "candidates")
    requests = best.select("h", doc_hash(F.col("excerpts")).alias("e"), F.col("excerpts").alias("input"))
    ctx.counters["unindexed_rows"] += there.join(index.members(ctx), "h", "left_anti").count()
    store = Verdicts(ctx)
    asked = requests.select(F.col("e").alias("h"), "input").dropDuplicates(["h"])
    known, misses = _known(ctx, store, query, "relevance", RELEVANCE, asked)
    schema = {"type": "object", "properties": {"score": {"type": "number", "description": "relevance from 0 to 1"}}, "required": ["score"], "additionalProperties": False}
    instruction = f"Score from 0 to 1 how relevant the excerpts are to the query. Answer with a JSON object.\nQuery: {query}\n"
    answers = ask(ctx, misses, lambda t, _: Request(instruction, t, 32, schema), lambda a: None if (s := score_of(a)) is None else repr(s), name="relevance")
    calls, failed = _counted(answers)
    ctx.counters.update({"candidate_rows": requests.count(), "model_calls": calls, "rows_failed": failed})
    usable = answers.where("value is not null")
    store.add(query, "relevance", RELEVANCE, usable, calls)
    scores = requests.join(known.unionByName(usable).toDF("e", "value"), "e", "left").select(F.col("h").alias(f"{h}v"), F.col("value").cast("double").alias(name))
    return rows.join(scores, F.col(h) == F.col(f"{h}v")).drop(h, f"{h}v")


def sem_cluster(ctx: Semantic, df: DataFrame, text: Column, index: Index, k: int | None = None, name: str = "label", seed: int = 1) -> DataFrame:
    """df with the name of each text's group by meaning; null for null texts and texts that the index lacks."""
    if k is not None and k < 1:
        raise SemanticError("MEANING OF ... INTO needs a positive number of groups")
    ctx.planned(f"SemanticCluster <= {k or 32} model calls")
    if ctx.dry:
        return df.withColumn(name, F.lit(None).cast("string"))
    rows, h = _hashed(df, text)
    asked = _requests(rows, text, h)
    vectors = ctx.stored(asked.select("h").join(doc_vectors(ctx, index), "h"), "vectors")
    groups = kmeans(ctx, vectors, k, seed)
    groups = ctx.stored(groups, "groups")
    ctx.counters["unindexed_rows"] += asked.join(index.members(ctx), "h", "left_anti").count()
    best = groups.withColumn("r", F.row_number().over(_by("g", "d", "h"))).where(F.col("r") <= CENTRAL).join(asked, "h")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "input"))), lambda x: x["input"]), SEPARATOR)
    # a group's identity: two order-free sums over its members
    identity = groups.groupBy("g").agg(F.xxhash64(F.count(F.lit(1)), F.bit_xor("h"), F.sum(F.xxhash64("h").cast("decimal(38,0)"))).alias("h"))
    requests = ctx.stored(best.groupBy("g").agg(joined.alias("input")).join(identity, "g"), "labels")
    store = Verdicts(ctx)
    known = ctx.stored(store.read("", "cluster", CLUSTER, requests), "known")
    schema = {"type": "object", "properties": {"label": {"type": "string", "description": "a short noun phrase"}}, "required": ["label"], "additionalProperties": False}
    build = lambda t, _: Request("Name in a noun phrase of at most five words what these documents share. Answer with a JSON object.\n", t, 64, schema)

    def parse(answer: str) -> str | None:
        label = (json_object(answer) or {}).get("label")
        return label.strip() or None if isinstance(label, str) else None

    answers = ask(ctx, requests.join(known, "h", "left_anti"), build, parse, name="cluster")
    usable = answers.where("value is not null")
    store.add("", "cluster", CLUSTER, usable)
    ctx.counters.update({"groups": requests.count(), "model_calls": answers.count(), "cache_hits": known.count(), "labels_failed": answers.where("value is null").count()})
    named: dict[int, str] = {}
    used: dict[str, int] = {}
    for r in requests.join(known.unionByName(usable), "h", "left").select("g", "value").orderBy("g").collect():  # a row a group
        label = r.value or f"group {r.g + 1}"
        used[label] = used.get(label, 0) + 1
        named[r.g] = label if used[label] == 1 else f"{label} ({used[label]})"
    labels = ctx.spark.createDataFrame(list(named.items()), f"g int, {h}l string")
    member = groups.select("g", F.col("h").alias(f"{h}v")).join(F.broadcast(labels), "g").drop("g")
    return rows.join(member, F.col(h) == F.col(f"{h}v"), "left").withColumn(name, F.col(f"{h}l")).drop(h, f"{h}v", f"{h}l")


def _by(group: str, *order: str):
    from pyspark.sql import Window

    return Window.partitionBy(group).orderBy(*order)


def kmeans(ctx: Semantic, vectors: DataFrame, k: int | None, seed: int = 1) -> DataFrame:
    """h, g (group number), d (squared distance to its centre); k by silhouette among 2, 4 ... 32 where not given."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.functions import array_to_vector

    n = vectors.count()
    if not n:
        return vectors.select("h", F.lit(0).alias("g"), F.lit(0.0).alias("d")).limit(0)
    data = vectors.select("h", "v", array_to_vector(F.col("v").cast("array<double>")).alias("features")).orderBy("h").cache()

    def fit(m: int):
        return KMeans(k=m, seed=seed, maxIter=50, initSteps=4).fit(data)

    try:
        if k is not None:
            chosen = fit(min(k, n)) if n > 1 else None
        else:
            chosen, best = None, -2.0
            for m in (2, 4, 8, 16, 32):
                if m < n:
                    model = fit(m)
                    out = model.transform(data)
                    score = ClusteringEvaluator(metricName="silhouette").evaluate(out) if out.select("prediction").distinct().count() > 1 else -1.0
                    if score > best:
                        chosen, best = model, score
        if chosen is None:
            first = F.row_number().over(_by("one", "h")) - 1
            return data.select("h", F.lit(1).alias("one")).select("h", first.cast("int").alias("g"), F.lit(0.0).alias("d"))
        centres = [c.tolist() for c in chosen.clusterCenters()]
        at = F.element_at(F.array(*[F.array(*[F.lit(x) for x in c]) for c in centres]), F.col("prediction") + 1)
        d = F.aggregate(F.zip_with("v", at, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
        return ctx.stored(chosen.transform(data).select("h", F.col("prediction").alias("g"), d.alias("d")), "kmeans")
    finally:
        data.unpersist()


def units(vectors: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.divide(vectors, norm, out=np.zeros_like(vectors), where=norm > 0)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarities of unit vectors, to nine places, so that ties don't depend on how they are computed."""
    return np.round(a @ b.T, 9)


def greedy_groups(vectors: np.ndarray, similarity: float) -> np.ndarray:
    """Place of each vector's representative: the most similar one so far, if similar enough, else itself."""
    unit = units(vectors)
    reps = np.empty_like(unit)
    who = np.empty(len(unit), np.int64)
    out = np.empty(len(unit), np.int64)
    n = 0
    for i, v in enumerate(unit):
        if n:
            s = likeness(v[None], reps[:n])[0]
            best = n - 1 - int(np.argmax(s[::-1]))  # the last of equals
            if s[best] >= similarity - 1e-9:
                out[i] = who[best]
                continue
        reps[n], who[n], out[i] = v, i, i
        n += 1
    return out


def greedy_representatives(ctx: Semantic, vectors: DataFrame, similarity: float) -> DataFrame:
    """h, rep of every vector (h, f, v) that has a representative: greedy_groups() in the order of h, over the cluster.

    Round by round, the first PREFIX vectors that no representative covers are grouped on the driver; those of them that are representatives are sent to
    all tasks, where every later vector remembers its most similar one and covered vectors leave the rest. A vector can become a representative only before
    it is covered, so that a round's choice is final: results are those of one sequential pass. No task holds more than PREFIX vectors besides its own batch.
    """
    left, parts = vectors, []
    while True:
        first = left.orderBy("h").limit(PREFIX).toArrow()
        if not first.num_rows:
            break
        h, v = first.column("h").to_numpy(), np.stack(first.column("v").to_numpy()).astype(np.float64)
        chosen = np.unique(greedy_groups(v, similarity))
        last = int(h[-1])
        shared = ctx.spark.sparkContext.broadcast((h[chosen], first.column("f").to_numpy()[chosen], units(v[chosen])))

        def scored(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
            at, _, reps = shared.value
            for batch in batches:
                for k in range(0, batch.num_rows, 1000):
                    part = batch.slice(k, 1000)
                    s = likeness(units(np.stack(part.column("v").to_numpy(zero_copy_only=False)).astype(np.float64)), reps)
                    s[at[None, :] > part.column("h").to_numpy()[:, None]] = -2  # representatives that come later
                    best = s.shape[1] - 1 - np.argmax(s[:, ::-1], axis=1)
                    yield part, best, s[np.arange(len(s)), best]

        def remembered(batches: Iterator[pa.RecordBatch], shared=shared, scored=scored) -> Iterator[pa.RecordBatch]:
            for part, best, s in scored(batches):
                near = pa.array(np.flatnonzero(s >= similarity - 1e-9))
                best = best[near.to_numpy()]
                yield pa.RecordBatch.from_arrays([part.column("h").take(near), pa.array(s[near.to_numpy()]), pa.array(shared.value[0][best]), pa.array(shared.value[1][best])], ["h", "s", "at", "rep"])

        def uncovered(batches: Iterator[pa.RecordBatch], scored=scored) -> Iterator[pa.RecordBatch]:
            for part, _, s in scored(batches):
                yield part.filter(pa.array(s < similarity - 1e-9))

        parts.append(ctx.stored(vectors.mapInArrow(remembered, "h long, s double, at long, rep long"), "near"))
        left = ctx.stored(left.where(F.col("h") > last).mapInArrow(uncovered, left.schema), "uncovered")
    if not parts:
        return vectors.select("h", F.col("f").alias("rep")).limit(0)
    every = functools.reduce(DataFrame.unionByName, parts)
    return every.groupBy("h").agg(F.max(F.struct("s", "at", "rep"))["rep"].alias("rep"))


def sem_distinct_key(ctx: Semantic, df: DataFrame, text: Column, index: Index, similarity: float = SIMILARITY, name: str = "key") -> DataFrame:
    """df with a key that near-duplicate texts share: the hash of their group's representative, texts taken in order of their hash.

    Null for null texts; a text that the index lacks has its own hash. No model is called.
    """
    if not 0 < similarity <= 1:
        raise SemanticError("SIMILARITY must be in (0, 1]")
    ctx.planned(f"SemanticDistinct similarity >= {similarity:g}, no model calls")
    if ctx.dry:
        return df.withColumn(name, F.lit(None).cast("string"))
    rows, h = _hashed(df, text)
    asked = ctx.stored(_requests(rows, text, h).withColumn("f", fnv1a64(F.col("input"))).select("h", "f"), "texts")
    vectors = ctx.stored(asked.join(doc_vectors(ctx, index), "h").select("h", "f", "v"), "vectors")
    groups = vectors.select("h", "f").join(greedy_representatives(ctx, vectors, similarity), "h", "left").select("h", F.coalesce("rep", "f").alias("rep"))
    groups = ctx.stored(groups, "distinct")
    ctx.counters.update({"groups": groups.select("rep").distinct().count(), "unindexed_rows": asked.count() - groups.count()})
    keys = asked.join(groups, "h", "left").select(F.col("h").alias(f"{h}v"), hex16(F.coalesce("rep", "f")).alias(name))
    return rows.join(keys, F.col(h) == F.col(f"{h}v"), "left").drop(h, f"{h}v")


def sem_extract(ctx: Semantic, df: DataFrame, text: Column, kind: SemanticType, names: dict[str, str]) -> DataFrame:
    """df with columns for the wanted fields (field -> column name). One call a text asks all units that are not known.

    Null where the text is null, the call failed or the value doesn't fit; a unit is stored if all its fields fit or are said to be absent.
    """
    for f in names:
        kind.named(f)
    units = kind.units(list(names))
    fields = [f for u in units for f in u]
    ctx.planned(f"SemanticExtract {kind.name} [{', '.join(f.name for f in fields)}]")
    if ctx.dry:
        return df.withColumns({n: F.lit(None).cast(kind.named(f).type.spark()) for f, n in names.items()})
    rows, h = _hashed(df, text)
    requests = _requests(rows, text, h)
    store = Verdicts(ctx)
    known = requests
    keys = [unit_key(u) for u in units]
    for i, key in enumerate(keys):
        known = known.join(store.read(f"{kind.name}@{key}", "unit", EXTRACT, requests).toDF("h", f"u{i}"), "h", "left")
    n = len(units)
    known = ctx.stored(known.withColumn("pending", F.filter(F.array(*[F.when(F.col(f"u{i}").isNull(), F.lit(i)) for i in range(n)]), lambda x: x.isNotNull())), "extract-known")
    ctx.counters["cache_hits"] += known.select(F.coalesce(F.sum(F.lit(n) - F.size("pending")), F.lit(0))).first()[0]

    def build(t: str, pending) -> Request:
        asked = [f for i in pending for f in units[i]]
        lines = "\n".join(f"{f.name}: {f.type.render()}. {f.doc}" for f in asked)
        keys = {f.name: f.type.schema() | {"description": f.doc} for f in asked}
        text = f"Extract these facts from the document as a JSON object with exactly these keys; null where the document doesn't say.\n{lines}\n"
        return Request(text, t, 2048, {"type": "object", "properties": keys, "required": list(keys), "additionalProperties": False})

    def parse(answer: str) -> str | None:
        found = json_object(answer)
        if found is None:
            return None
        out = {}
        for i, unit in enumerate(units):
            values = {f.name: f.type.check(found[f.name]) if found.get(f.name) is not None else None for f in unit}
            whole = all(f.name in found and (found[f.name] is None or values[f.name] is not None) for f in unit)
            out[str(i)] = json.dumps({"ok": whole, "values": values})
        return json.dumps(out)

    answers = ask(ctx, known.where(F.size("pending") > 0), build, parse, "pending", "extract")
    calls, failed = _counted(answers)
    ctx.counters.update({"extract_model_calls": calls, "rows_failed": failed})
    given = answers.withColumn("given", F.from_json("value", "map<string,string>")).drop("value")
    unit = lambda i: F.when(F.array_contains("pending", i), F.element_at("given", str(i)))
    both = ctx.stored(known.join(given, "h", "left").select("h", *[F.coalesce(F.col(f"u{i}"), unit(i)).alias(f"u{i}") for i in range(n)], *[unit(i).alias(f"n{i}") for i in range(n)]), "extracted")
    for i, key in enumerate(keys):
        store.add(f"{kind.name}@{key}", "unit", EXTRACT, both.where(F.get_json_object(f"n{i}", "$.ok") == "true").select("h", F.col(f"n{i}").alias("value")), calls)
    failed = F.lit(0)
    for i in range(n):
        failed = failed + F.coalesce((F.get_json_object(f"n{i}", "$.ok") == "false").cast("int"), F.lit(0))
    ctx.counters["fields_failed"] += both.select(F.coalesce(F.sum(failed), F.lit(0))).first()[0]
    columns = []
    for i, u in enumerate(units):
        struct = "struct<" + ",".join(f"`{f.name}`:{f.type.spark().simpleString()}" for f in u) + ">"
        parsed = F.from_json(F.col(f"u{i}"), f"struct<ok:boolean,values:{struct}>")
        columns += [parsed["values"][f.name].alias(names[f.name]) for f in u if f.name in names]
    values = both.select(F.col("h").alias(f"{h}v"), *columns)
    return rows.join(values, F.col(h) == F.col(f"{h}v"), "left").drop(h, f"{h}v")


def whole_struct(kind: SemanticType, names: dict[str, str], text: Column) -> Column:
    """The type's fields as one struct, null where the text is null."""
    return F.when(text.isNotNull(), F.struct(*[F.col(names[f.name]).alias(f.name) for f in kind.fields]))


__all__ = ["FETCH", "Field", "greedy_groups", "sem_classify", "sem_cluster", "sem_distinct_key", "sem_extract", "sem_filter", "sem_rank", "threshold_for", "whole_struct"]
