"""The pipeline's stages by themselves and together."""

import collections
import math

import corpus_pipeline as P
from pyspark.sql import functions as F

from gridseek.llm import decontam, toxicity
from tests.llm.test_operators import SPACED, UPPER, counted, hits, near_components, order, targets
from tests.llm.texts import SCHEMA, documents


def test_stages(spark, tmp_path):
    docs = spark.createDataFrame(documents(), SCHEMA).select("doc_id", "text", "lang", "source", "n_chars")
    rows = documents()
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    item = next(r[1] for r in rows if r[0] == 20)
    spark.createDataFrame([(1, item[-300:])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, 0, int(i % 9 == 0)) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    at = docs
    for name, stage in P.STAGES[:-1]:
        now = stage(spark, at, str(tmp_path))
        assert now.columns == docs.columns and now.dtypes == docs.dtypes, name
        now.write.parquet(f"{tmp_path}/{name.replace(' ', '_')}")
        kept = spark.read.parquet(f"{tmp_path}/{name.replace(' ', '_')}")
        assert kept.count() <= at.count()
        at = kept
    last = P.STAGES[-1][1](spark, at, str(tmp_path))
    want = sorted(map(str, last.collect()))
    assert sorted(map(str, P.run(spark, str(tmp_path)).collect())) == want and len(want) == at.count()
    assert len(want) < docs.count()
    for name, stage in P.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name


def test_names():
    assert [n for n, _ in P.STAGES] == ["toxicity", "line dedup", "near duplicates", "decontamination", "mixing"]


def without_lines(rows, words=50, window=3):
    """Plain program of the second stage."""
    seen, out = {}, {}
    for doc_id, text in sorted({(r[0], r[1]) for r in rows if r[1] is not None}, key=lambda r: order(r[0])):
        parts = text.split("\n")
        at = [i for i, x in enumerate(parts) if SPACED.search(x)]
        gone, mine = set(), set()
        for size in range(1, window + 1):
            for j in range(len(at) - size + 1):
                run = tuple(parts[i] for i in at[j : j + size])
                long = size == window or len(SPACED.findall(" ".join(run))) >= words
                for key in [("long", run)] * long + [("text", run)] * (len(at) == size < window):
                    if key in mine or seen.get(key, math.inf) < order(doc_id):
                        gone.update(at[j : j + size])
                    mine.add(key)
                    seen.setdefault(key, order(doc_id))
        out[doc_id, text] = "\n".join(x for i, x in enumerate(parts) if i not in gone)
    return [(r[0], None if r[1] is None else out[r[0], r[1]], r[2]) for r in rows]


def test_run_against_plain_programs(spark, tmp_path):
    """All five stages; the learned verdicts of the first are taken as they are, which its own tests hold against labels."""
    made = [(r[0], r[1], r[3]) for r in documents()]
    made += [(100 + i, f"{t} vileone vileother nastier", "s1") for i, (_, t, _) in enumerate(made[:30])]
    docs = spark.createDataFrame([(i, t, "en", s, 0) for i, t, s in made], "doc_id long, text string, lang string, source string, n_chars long")
    passage = next(t for i, t, _ in made if i == 20)[-300:]
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, 0, int(i >= 100)) for i in [*range(40), *range(100, 130)]], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")

    bad = collections.Counter((r.doc_id, r.t1) for r in toxicity._scored(docs, spark.read.parquet(f"{tmp_path}/labels.parquet")).where("predicted = 1").collect())
    hashed = {(r.doc_id, r.text): r.h for r in docs.select("doc_id", "text", F.xxhash64("text").alias("h")).collect()}
    rows = [r for r in made if (r[0], hashed[r[0], r[1]]) not in bad]
    rows = without_lines(rows)
    kept = {k[0] for k in near_components(rows, 80) if k[3]}
    rows = [r for r in rows if r[0] is None or r[0] in kept]
    words = decontam.WORD.findall(passage.translate(UPPER))
    windows = {tuple(words[j : j + 10]): {1} for j in range(len(words) - 9)}
    rows = [r for r in rows if not hits(r[1], windows, decontam.WORD)[1]]
    by, want = collections.defaultdict(list), collections.Counter()
    last = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for r in last.select("*", F.xxhash64(F.lit(11), "doc_id", "text").alias("o"), F.xxhash64("text", F.lit(11)).alias("tie")).collect():
        by[r.source].append((r.o, order(r.doc_id), r.tie, len(SPACED.findall(r.text or "")), r.doc_id))
    goal = targets({s: sum(x[3] for x in own) for s, own in by.items()})
    for s, own in by.items():
        whole, at = sum(x[3] for x in own), 0
        passes, rest = divmod(round(goal[s]), whole) if whole else (0, 0)
        for _, _, _, n, doc_id in sorted(own):
            want[doc_id, s, n, passes * n + max(0, min(rest, at + n) - at)] += 1
            at += n
    assert 0 < len(bad) and len(rows) < len(made) - len(bad)
    assert counted(P.run(spark, str(tmp_path)), "doc_id", "source", "size", "taken") == want
