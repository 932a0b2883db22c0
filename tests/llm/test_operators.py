"""Each operator against a plain program of its own, on a small table with all that it must bear, and on an empty one."""

import collections
import hashlib
import math
import random
import re
import sys

import pytest
from pyspark.sql import functions as F

from gridseek.llm import decontam, linededup, mixing, neardup, pii, suffixdedup, tokencount, topk, toxicity, urlgraph
from tests.llm.texts import SCHEMA, documents, prose

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def rows():
    return documents()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def counted(frame, *names):
    return collections.Counter(tuple(r[n] for n in names) for r in frame.collect())


def order(doc_id):
    return -(1 << 63) if doc_id is None else doc_id


# token counts


def test_tokens_equal_the_library_at_every_prefix():
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=tokencount.default_model())
    counter = tokencount.PrefixCounter(tokencount.default_model())
    rng = random.Random(1)
    texts = ["", "a", " a", "  a", "a  ", "\n\n a\t b", "▁x", "<s> hi </s>", "日本語 😀😀", "   ", "a" * 200, "\x00b", "    def f(x):\n        return"]
    texts += ["".join(rng.choice("ab \n▁éth<s>0e日😀") for _ in range(rng.randint(0, 30))) for _ in range(200)]
    texts.append(prose(rng, 30))
    assert counter.count_all(texts) == [len(x) for x in sp.encode(texts)]
    for t in texts[:60]:
        assert counter.prefixes(t) == [len(sp.encode(t[:i])) for i in range(len(t) + 1)]
    long = texts[-1]
    cut = counter.truncate(long, 50)
    assert len(sp.encode(cut)) <= 50 and long.startswith(cut)
    assert all(len(sp.encode(long[:i])) > 50 for i in range(len(cut) + 1, min(len(long), len(cut) + 40)))


def test_tokens_equal_the_library_across_edges_and_when_little_is_remembered(monkeypatch):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=tokencount.default_model())
    rng = random.Random(2)
    signs = "abcdeThéИкл据数取,.;:!?'\"()[]{}<>/\\|=+-_*&%$#@~`^…–“”«»0129 ▁\n\t\r\x00─═ß😀"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(1, 40))) for _ in range(3000)] + [prose(rng, 40), "x" * 500, ".,;" * 60, "▁ " * 70, "据数取获" * 30, "    a--b==c ...\n\n\n"]
    want = [len(x) for x in sp.encode(texts)]
    assert tokencount.PrefixCounter(tokencount.default_model()).count_all(texts) == want
    for name in ("REMEMBERED", "PAIRS", "STEPS", "LONGEST"):
        monkeypatch.setattr(tokencount, name, 7)
    counter = tokencount.PrefixCounter(tokencount.default_model())
    assert [counter.count(t) for t in texts] == want
    for t in texts[:40]:
        assert counter.prefixes(t) == [len(sp.encode(t[:i])) for i in range(len(t) + 1)]


def test_tokens_of_new_words_take_few_steps():
    counter = tokencount.PrefixCounter(tokencount.default_model())
    rng = random.Random(3)
    word = lambda: "".join(rng.choice(["th", "re", "on", "an", "er", "st", "ing", "tion", "sh", "ble", "ou", "is"]) for _ in range(rng.randint(2, 5)))
    counter.count_all([" ".join(word() for _ in range(20_000))])  # from here on most pairs of pieces are known
    words, calls = [word() for _ in range(5000)], 0
    text = "".join(w + rng.choice([" ", ", ", ".\n", "; ", " (", ") "]) for w in words)

    def called(frame, event, arg):
        nonlocal calls
        calls += event in ("call", "c_call")

    sys.setprofile(called)
    try:
        counter.count_all([text])
    finally:
        sys.setprofile(None)
    assert calls < 3 * len(text)


def test_token_counts(docs, none, rows):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=tokencount.default_model())
    got = counted(tokencount.token_counts(docs, limit=100), "doc_id", "n_bytes", "n_tokens", "over_limit")
    assert got == collections.Counter((r[0], len((r[1] or "").encode()), n := len(sp.encode(r[1] or "")), n > 100) for r in rows)
    assert tokencount.token_counts(none).count() == 0
    lists = {r.doc_id: r.counts for r in tokencount.prefix_counts(docs.where("doc_id in (43, 44, 40, 41)")).collect()}
    assert lists[40] == lists[41] == [0] and lists[43] == [len(sp.encode("Word"[:i])) for i in range(5)]
    assert all(len(sp.encode(r.text or "")) <= 7 for r in tokencount.truncated(docs, 7).collect())


# benchmark decontamination


def hits(text, windows, kind):
    words = kind.findall((text or "").translate(UPPER))
    hit, items = set(), set()
    for n in {len(w) for w in windows}:
        for j in range(len(words) - n + 1):
            if found := windows.get(tuple(words[j : j + n])):
                items |= found
                hit.update(range(j, j + n))
    return words, hit, items


def test_contamination(spark, docs, none, rows):
    bench = [(i, rows[i][1][:400] if rows[i][1] else None) for i in range(0, 12)] + [(50, ""), (51, None), (52, "of AND!"), (53, "Word"), (None, rows[3][1]), (52, "of AND!")]
    items = spark.createDataFrame([(i, t, 1) for i, t in bench], "item_id long, text string, rid long")
    windows = {}
    for i, t in bench:
        words = decontam.WORD.findall((t or "").translate(UPPER))
        n = min(10, len(words))
        for j in range(len(words) - n + 1 if n else 0):
            windows.setdefault(tuple(words[j : j + n]), set()).add(i)
    want = collections.Counter()
    for r in rows:
        words, hit, found = hits(r[1], windows, decontam.WORD)
        names = sorted(str(i) for i in found if i is not None)
        want[r[0], len(words), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)] += 1
    got = counted(decontam.contamination(docs, items), "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert got == want and any(k[2] for k in want) and not all(k[2] for k in want)
    # a filter that lets all pass gives the same
    assert counted(decontam.contamination(docs, items, bloom_bits=64), "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == want
    kept = decontam.decontaminated(docs, items)
    assert kept.columns == docs.columns and counted(kept, "doc_id", "text") == collections.Counter((r[0], r[1]) for r in rows if not hits(r[1], windows, decontam.WORD)[1])
    assert decontam.contamination(none, items).count() == 0
    assert {r.n_hit for r in decontam.contamination(docs, items.limit(0)).collect()} == {0}


# repeated byte strings


def without_repeats(rows, width=100):
    seen, out = {}, collections.Counter()
    own = {}
    for doc_id, text in sorted({(r[0], r[1] or "") for r in rows}, key=lambda r: order(r[0])):
        raw = text.encode()
        gone = bytearray(len(raw))
        mine = set()
        for p in range(len(raw) - width + 1):
            w = raw[p : p + width]
            if w in mine or seen.get(w, math.inf) < order(doc_id):
                gone[p : p + width] = b"\x01" * width
            mine.add(w)
            seen.setdefault(w, order(doc_id))
        spans = sum(1 for i in range(len(gone)) if gone[i] and (i == 0 or not gone[i - 1]))
        own[doc_id, text] = (len(raw), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(raw, gone) if not g)).hexdigest())
    for r in rows:
        out[(r[0], *own[r[0], r[1] or ""])] += 1
    return out


@pytest.mark.parametrize("bits", [1 << 28, 64])
def test_repeats(docs, none, rows, bits):
    got = suffixdedup.without_repeats(docs, bloom_bits=bits)
    want = without_repeats(rows)
    assert counted(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == want
    assert sum(k[2] for k in want) > 1000
    assert suffixdedup.without_repeats(none).count() == 0


def test_repeats_of_periods_and_long_texts(spark):
    rng = random.Random(5)
    base = "".join(rng.choice("abc d") for _ in range(3000))
    long = "".join(rng.choice("xyz w") for _ in range(150_000))
    texts = ["a" * 700, "b" + "ab" * 300, base, base[1000:2000] + "!" + base[500:900], base + base, long + base[:150], long[140_000:] + long[:300], "x" * 99, "é" * 99]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, "other " + base[:300])]
    frame = spark.createDataFrame(rows, "doc_id int, text string").repartition(4)
    assert counted(suffixdedup.without_repeats(frame), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == without_repeats(rows)


# lines


def without_lines(rows, window=3):
    seen, own = {}, {}
    for doc_id, text in sorted({(r[0], r[1]) for r in rows if r[1] is not None}, key=lambda r: order(r[0])):
        lines = text.split("\n")
        at = [i for i, x in enumerate(lines) if SPACED.search(x)]
        gone, mine = set(), set()
        for j in range(len(at) - window + 1):
            w = tuple(lines[i] for i in at[j : j + window])
            if w in mine or seen.get(w, math.inf) < order(doc_id):
                gone.update(at[j : j + window])
            mine.add(w)
            seen.setdefault(w, order(doc_id))
        own[doc_id, text] = ("\n".join(x for i, x in enumerate(lines) if i not in gone), len(at), len(gone))
    return collections.Counter((r[0], *(own[r[0], r[1]] if r[1] is not None else (None, 0, 0))) for r in rows)


def test_lines(docs, none, rows):
    got = linededup.line_deduplicated(docs)
    want = without_lines(rows)
    assert counted(got, "doc_id", "text", "n_lines", "n_removed") == want and sum(k[3] for k in want) > 10
    assert got.columns == [*docs.columns, "n_lines", "n_removed"]
    assert linededup.line_deduplicated(none).count() == 0


def test_line_hashes_win_where_files_are_cut(spark):
    many = spark.createDataFrame([(i, "\n".join(f"line {j}" for j in range(i, i + 6))) for i in range(60)], "doc_id long, text string").repartition(7)
    rows = [(r.doc_id, r.text) for r in many.collect()]
    assert counted(linededup.line_deduplicated(many), "doc_id", "text", "n_lines", "n_removed") == without_lines(rows)


def test_short_runs_of_many_words_and_short_texts(spark):
    def without(rows, words, window=3):
        seen, out = {}, collections.Counter()
        for doc_id, text in sorted(rows):
            lines = text.split("\n")
            at = [i for i, x in enumerate(lines) if SPACED.search(x)]
            gone, mine = set(), set()
            for size in range(1, window + 1):
                for j in range(len(at) - size + 1):
                    run = tuple(lines[i] for i in at[j : j + size])
                    for key in [("long", run)] * (size == window or len(SPACED.findall(" ".join(run))) >= words) + [("text", run)] * (len(at) == size < window):
                        if key in mine or seen.get(key, math.inf) < doc_id:
                            gone.update(at[j : j + size])
                        mine.add(key)
                        seen.setdefault(key, doc_id)
            out[doc_id, "\n".join(x for i, x in enumerate(lines) if i not in gone), len(at), len(gone)] += 1
        return out

    rng = random.Random(9)
    pool = [" ".join(f"w{rng.randrange(999)}" for _ in range(n)) for n in (2, 5, 9, 10, 12, 20)]
    rows = [(i, "\n".join(rng.choice([*pool, f"only {i} {j}", " "]) for j in range(rng.randint(1, 7)))) for i in range(150)]
    rows += [(200, "short text"), (201, "short text"), (202, "a\n\nb"), (203, "a\nb"), (204, "x 1\nshort text\nx 2"), (205, f"{pool[5]}\nz 1"), (206, f"y\n{pool[5]}")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = linededup.line_deduplicated(frame, words=10)
    assert counted(got, "doc_id", "text", "n_lines", "n_removed") == without(rows, 10)
    kept = {r.doc_id: r.text for r in got.collect()}
    assert kept[201] == kept[203] == "" and kept[204].count("\n") == 2 and kept[206] == "y"


def test_the_pipeline_drops_a_long_line_that_repeats(spark):
    passage = " ".join(f"word{i}" for i in range(60))
    frame = spark.createDataFrame([(1, f"one\n{passage}", 0), (2, f"{passage}\ntwo", 0)], "doc_id long, text string, n_chars long")
    from corpus_pipeline import drop_repeated_lines

    assert {r.doc_id: r.text for r in drop_repeated_lines(spark, frame, "").collect()} == {1: f"one\n{passage}", 2: "two"}


# near duplicates


def near_components(rows, percent):
    sets, ids = {}, sorted({r[0] for r in rows if r[0] is not None})
    for r in rows:
        words = SPACED.findall((r[1] or "").translate(UPPER))
        sets.setdefault(r[0], set()).add(frozenset(tuple(words[j : j + 5]) for j in range(max(1, len(words) - 4))) if words else frozenset())
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    out = collections.Counter()
    for r in rows:
        words = SPACED.findall((r[1] or "").translate(UPPER))
        n = len({tuple(words[j : j + 5]) for j in range(max(1, len(words) - 4))}) if words else 0
        c = None if r[0] is None else find(r[0]) if n else r[0]
        out[r[0], n, c, r[0] is None or c == r[0]] += 1
    return out


def test_near_duplicates(docs, none, rows):
    got = neardup.near_duplicates(docs)
    want = near_components(rows, 85)
    assert counted(got, "doc_id", "n_shingles", "component_id", "kept") == want
    assert sum(not k[3] for k in want) >= 2
    kept = neardup.one_each(docs, 85)
    good = {k[0] for k in want if k[3]}
    assert kept.columns == docs.columns and counted(kept, "doc_id") == collections.Counter((r[0],) for r in rows if r[0] in good or r[0] is None)
    assert neardup.near_duplicates(none).count() == 0


def test_a_star_of_near_copies(spark):
    """Copies of one text, alike to it but hardly to each other, in more members than a node is compared whole with."""
    rng = random.Random(9)
    base = [rng.choice("abcdefgh") + str(rng.randint(0, 99)) for _ in range(240)]
    rows = []
    for i in range(90):
        words = list(base)
        for j in rng.sample(range(240), 0 if i == 41 else rng.choice([1, 3, 4, 5])):
            words[j] = f"w{i}x{j}"
        rows.append((i, " ".join(words)))
    rows += [(200 + i, prose(rng, 8)) for i in range(20)] + [(300 + i, rows[i][1].upper()) for i in range(10)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert counted(neardup.near_duplicates(frame), "doc_id", "n_shingles", "component_id", "kept") == near_components(rows, 85)


def test_trees_follow_the_similarity():
    for percent in (70, 80, 85, 95):
        n = neardup.trees_for(percent, 3)
        assert (1 - (percent / 100) ** 3) ** n <= 1e-4 < (1 - (percent / 100) ** 3) ** (n - 1)
    assert neardup.trees_for(85, 3) == 10 and neardup.trees_for(80, 3) == 13


# mixing


def targets(sizes, weights=(3, 1, 2)):
    order_ = sorted(s for s in sizes if s is not None) + ([None] if None in sizes else [])
    weight = {s: weights[i % 3] for i, s in enumerate(order_)}
    total, fixed = 1.5 * sum(sizes.values()), {}
    while True:
        free = [s for s in order_ if s not in fixed]
        level = (total - sum(fixed.values())) / sum(weight[s] for s in free) if free else 0
        over = [s for s in free if weight[s] * level > 2 * sizes[s]]
        if not over:
            return {s: fixed.get(s, weight[s] * level) for s in order_}
        fixed |= {s: 2.0 * sizes[s] for s in over}


def test_mixing(docs, none, rows):
    got = mixing.mixed(docs, block=16).collect()
    sizes = collections.Counter()
    for r in rows:
        sizes[r[3]] += len(SPACED.findall(r[1] or ""))
    want = targets(sizes)
    assert len(got) == len(rows)
    taken = collections.Counter()
    text = {r[0]: r[1] for r in rows if r[0] is not None}
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source]) and 0 <= r.taken <= 2 * r["size"]
        assert r.doc_id is None or r["size"] == len(SPACED.findall(text[r.doc_id] or ""))
        taken[r.source] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 1
    again = mixing.mixed(docs.repartition(7), block=16).collect()
    assert collections.Counter(got) == collections.Counter(again)
    assert mixing.mixed(none).count() == 0


def test_words_taken_of_each_document(spark, docs, rows):
    """A source's slots take its shuffled words in order, again and again, up to the target."""
    hashed = docs.select("doc_id", "text", "source", F.xxhash64(F.lit(11), "doc_id", "text").alias("o"), F.xxhash64("text", F.lit(11)).alias("tie")).collect()
    by = collections.defaultdict(list)
    for r in hashed:
        by[r.source].append((r.o, order(r.doc_id), r.tie, len(SPACED.findall(r.text or "")), r.doc_id))
    want = collections.Counter()
    goal = targets({s: sum(x[3] for x in own) for s, own in by.items()})
    for s, own in by.items():
        whole = sum(x[3] for x in own)
        passes, rest = divmod(round(goal[s]), whole) if whole else (0, 0)
        at = 0
        for _, _, _, n, doc_id in sorted(own):
            want[doc_id, s, n, passes * n + max(0, min(rest, at + n) - at)] += 1
            at += n
    assert counted(mixing.mixed(docs, block=16), "doc_id", "source", "size", "taken") == want


def test_schedule_is_even(spark):
    parts = spark.createDataFrame([(1, 0.0, 0.5, 500.0, 700), (2, 0.5, 0.8, 300.0, 400), (3, 0.8, 1.0, 200.0, 130)], "rank int, low double, high double, target double, source_size long")
    slots = sorted((r.slot, r["rank"], r.turn) for r in mixing.schedule(parts, 1000, 1).collect())
    seen = collections.Counter()
    for slot, rank, turn in slots:
        assert turn == seen[rank]
        seen[rank] += 1
        if slot < 900:
            for k, share in ((1, 0.5), (2, 0.3), (3, 0.2)):
                assert abs(seen[k] - share * (slot + 1)) < 6
    assert seen == {1: 500, 2: 300, 3: 200}


def test_a_source_without_words(spark):
    frame = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (3, "x y z", "c")], "doc_id long, text string, source string")
    assert {(r.doc_id, r.target, r.taken) for r in mixing.mixed(frame).collect()} == {(1, 0.0, 0), (2, 0.0, 0), (3, 4.5, 5)}
    assert {r.taken for r in mixing.mixed(frame.where("doc_id < 3")).collect()} == {0}


# toxicity


def test_toxicity_on_held_out_documents(spark):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(900):
        words = prose(rng, rng.randint(2, 8)).split(" ")
        bad = i % 6 == 0
        for _ in range(rng.randint(1, 6) if bad else 0):
            words.insert(rng.randrange(len(words)), rng.choice(["Vileone", "vileother", "nastier,"]))
        rows.append((i, " ".join(words), "en", 7))
        labels.append((i, int(bad), 0))
    rows += [(1000, None, "en", 1), (1001, "", "en", 1), (None, "vileone and vileother", "en", 1), (5, rows[5][1], "en", 7)]
    labels += [(None, 1, 0), (3, None, 0), (0, 0, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, held_out long").repartition(4)
    marks = spark.createDataFrame(labels, "doc_id long, toxic int, quality int")
    got = toxicity.toxicity(docs, marks).collect()
    assert len(got) == len(rows)
    truth = {i: t for i, t, _ in labels[:900]}
    out = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(out) > 200 and all((r.predicted == 1) == (truth[r.doc_id] == 1) for r in out)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    assert all(not r.segments and r.score < 0.2 for r in got if r.doc_id in (1000, 1001))
    kept = toxicity.without_toxic(docs, marks)
    assert kept.columns == docs.columns and collections.Counter(r.doc_id for r in kept.collect()) == collections.Counter(r.doc_id for r in got if not r.predicted)
    empty = toxicity.toxicity(docs, marks.limit(0)).collect()
    assert len(empty) == len(rows) and not any(r.predicted for r in empty)
    assert toxicity.toxicity(docs.limit(0), marks).count() == 0


def test_labels_of_held_out_rows_change_nothing(spark):
    rng = random.Random(4)
    docs = spark.createDataFrame([(i, prose(rng, 3) + (" vile" if i % 4 == 0 else "")) for i in range(200)], "doc_id long, text string")
    marks = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(200)], "doc_id long, toxic int")
    flipped = marks.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert counted(toxicity.toxicity(docs, marks), "doc_id", "score") == counted(toxicity.toxicity(docs, flipped), "doc_id", "score")


def test_toxic_copies_do_not_hide_the_words_they_share(spark):
    rng = random.Random(6)
    bad = ["vileone", "vileother", "nastier"]

    def text(marks):
        words = prose(rng, rng.randint(2, 8)).split(" ")
        for m in marks:
            words.insert(rng.randrange(len(words)), m)
        return " ".join(words)

    rows = [(i, text(rng.choices(bad, k=3) if i % 6 == 0 else []), int(i % 6 == 0)) for i in range(600)]
    copied = text(bad)
    rows += [(600 + i, copied if i % 2 else copied.replace(" ", "  ").upper(), 1) for i in range(300)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, toxic int").repartition(4)
    got = toxicity.toxicity(frame.drop("toxic"), frame.drop("text")).collect()
    truth = {i: t for i, _, t in rows}
    assert len(got) == len(rows) and all(r.predicted == truth[r.doc_id] for r in got)
    assert toxicity.without_toxic(frame, frame.drop("text")).count() == 500


def test_telling_features_against_plain_counts(spark):
    """Words and their beginnings, counted as texts in plain sets; copies count once."""
    rng = random.Random(8)
    vocabulary = ["".join(rng.choices("abcdefgh", k=rng.randint(1, 9))) for _ in range(300)]
    texts = [(int(i % 5 == 0), rng.choices(vocabulary, k=rng.randint(1, 40)) + rng.choices(vocabulary[:6], k=3 * (i % 5 == 0))) for i in range(400)]
    texts += [texts[0]] * 30
    rows = [(i, " ".join(words), y) for i, (y, words) in enumerate(texts)]
    frame = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic long")
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string").repartition(4)
    labelled = toxicity._labelled(docs, frame)
    held, occurrences = {0: collections.Counter(), 1: collections.Counter()}, collections.Counter()
    different = {(y, tuple(words)) for y, words in texts}
    for y, words in different:
        held[y].update({(n, w[:n] if n else w) for w in words for n in (0, *toxicity.BEGINNINGS)})
    for _, words in texts:
        occurrences.update((n, w[:n] if n else w) for w in words for n in (0, *toxicity.BEGINNINGS))
    n1 = sum(y for y, _ in different)
    n0, want = len(different) - n1, []
    for f, t in held[1].items():
        c = held[0][f]
        share = n1 / (n1 + n0)
        ratio = 2 * (t * math.log(t / ((t + c) * share)) + (c * math.log(c / ((t + c) * (1 - share))) if c else 0))
        if ratio >= 10 and t * n0 > c * n1:
            want.append((t, c, occurrences[f]))
    features, toxic, clean = toxicity._telling(labelled, n1, n0, 10.0)
    seen, total = toxicity._occurrences(docs, features)
    assert len(want) > 5 and labelled.count() == len(different)
    assert sorted(zip(toxic.tolist(), clean.tolist(), seen.tolist())) == sorted(want) and total == sum(occurrences.values())


def test_maximal_segments():
    """The definition: of all contiguous runs the best one, then the same to its left and its right."""

    def plain(scores, base=0):
        best = max(((sum(scores[i:j]), -(j - i), -i) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)), default=(0,))
        if best[0] <= 1e-12:
            return []
        i, j = -best[2], -best[2] - best[1]
        return plain(scores[:i], base) + [(base + i, base + j, best[0])] + plain(scores[j:], base + j)

    rng = random.Random(8)
    for _ in range(200):
        n = rng.randint(0, 14)
        marked = {i: rng.uniform(0.5, 3) for i in range(n) if rng.random() < 0.4}
        got = toxicity.maximal_segments(sorted(marked), [marked[i] for i in sorted(marked)], 0.83)
        want = plain([marked.get(i, -0.83) for i in range(n)])
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
        assert [s for *_, s in got] == pytest.approx([s for *_, s in want])


# url filters


def test_rules_and_hosts(spark):
    urls = ["http://A.Example.ORG/es/x?q#f", "https://example.org/en/1/b", "http://example.org/en/2", "ftp://x.com/fr/1", "http://x.com/de/", "http://com/de", "http://x.net/y", "no url", None, "", "http://org", "http://org/", "x://y://z/k", "http://notexample.org/es/", "http://ex.com?de/"]
    pages = spark.createDataFrame([(i, u, None, "h") for i, u in enumerate(urls)], "page_id long, url string, html string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlgraph.judged(pages).collect()}
    assert got[0] == ("a.example.org", "/es/x", "example.org/es/", "block")
    assert got[1] == ("example.org", "/en/1/b", "example.org/en/1", "block")
    assert got[2] == ("example.org", "/en/2", "org/", "allow")
    assert got[3] == ("x.com", "/fr/1", "com/fr/", "allow") and got[4] == ("x.com", "/de/", "com/de/", "block")
    assert got[5] == ("com", "/de", None, "allow") and got[6] == ("x.net", "/y", None, "allow")
    assert got[7] == got[8] == got[9] == ("", "", None, "allow")
    assert got[10] == ("org", "", None, "allow") and got[11][2:] == ("org/", "allow")
    assert got[12][:2] == ("y:", "//z/k") and got[13][2] == "org/" and got[14][:2] == ("ex.com", "")
    assert urlgraph.judged(pages.limit(0)).count() == 0


def test_link_graph(spark):
    link = lambda *hosts: "".join(f'<a href="http://{h}/">x</a>' for h in hosts)
    pages = [(1, "http://good.org/a", link("friend.net")), (2, "http://bad.com/de/", link("friend.net")), (3, "http://spam.net/1", link("bad.com", "bad.com")), (4, "http://friend.net/", link("other.net")), (5, "http://hub.net/", link("spam.net")), (6, "http://alone.net/", None)]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r.page_id: r.verdict for r in urlgraph.judged(frame).collect()}
    assert got == {1: "allow", 2: "block", 3: "block", 4: "allow", 5: "block", 6: "allow"}


# top-k


def best_products(rows, k=5, every=50):
    ok = [(i, [math.floor(256 * float(x)) for x in v]) for i, v, _ in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = collections.Counter()
    for qi, q in ok:
        if qi % every == 0:
            scores = sorted((-sum(a * b for a, b in zip(q, c)), ci) for ci, c in ok if ci != qi and len(c) == len(q))[:k]
            out.update((qi, r + 1, ci, -s) for r, (s, ci) in enumerate(scores))
    return out


@pytest.mark.parametrize("spread", [0.0, 0.02, 1.5])
def test_top_k(spark, spread):
    rng = random.Random(int(spread * 100))
    centre = [rng.gauss(0, 1) for _ in range(6)]
    rows = []
    for i in range(400):
        v = [c + rng.gauss(0, spread) for c in centre] if i % 3 else [rng.gauss(0, 1) for _ in range(6)]
        rows.append((i, [x * rng.choice([0.1, 1, 1, 3]) for x in v], i))
    rows += [(450, [0.0] * 6, 1), (451, None, 1), (452, [], 1), (453, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (454, [float("nan")] * 6, 1), (455, [float("inf")] * 6, 1), (500, [1.0, 2.0], 1), (501, [2.0, 2.0], 1), (None, [1.0] * 6, 1), (7, rows[7][1], 1), (550, [-50.0] * 6, 1)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score long").repartition(5)
    assert counted(topk.top_k(frame), "query_id", "rank", "vec_id", "score") == best_products(rows)
    assert topk.top_k(frame.limit(0)).count() == 0


# personal data


def luhn(number):
    digits = [int(c) for c in re.sub(r"\D", "", number)]
    return sum(sum(divmod(2 * d, 10)) if i % 2 else d for i, d in enumerate(reversed(digits))) % 10 == 0


def test_pseudonyms(spark, docs, none, rows):
    values = ["4111111111111111", "5500 0055 5555 5559", "3782-822463-10005", "+1 (456) 555-2186", "212-555-0187", "123-45-6789", "8.8.4.4", "192.168.100.7", "2024-02-29", "31.12.1999", "01/02/2003"]
    table = [(i, f"say {v}, and again {v}.\n{v}") for i, v in enumerate(values)]
    table += [(50, "mail Jo.Doe+x@mail.example.com now"), (51, "4111111111111112 2024-02-30 300.1.1.1 1.2.3 v4.0. 555 $100"), (52, None), (53, ""), (54, "x" * 100_000 + " 8.8.4.4 " + "y" * 100_000), (0, table[0][1])]
    frame = spark.createDataFrame([(*r, "f", "n") for r in table], "doc_id long, text string, found string, new string")
    got = pii.pseudonymized(frame, "k")
    assert got.columns == [*frame.columns, "n_found"]
    out = {r.doc_id: r for r in got.collect()}
    for i, v in enumerate(values):
        new = re.fullmatch(r"say (.*), and again (.*)\.\n(.*)", out[i].text)
        assert new and len(set(new.groups())) == 1 and new[1] != v and out[i].n_found == 3
        assert re.sub(r"\d", "9", new[1]) == re.sub(r"\d", "9", v) or i in (6, 7)
        if i < 3:
            assert luhn(new[1])
    assert re.fullmatch(r"mail u[0-9a-f]{16}@example\.invalid now", out[50].text)
    assert out[51].text == table[12][1] and out[51].n_found == 0
    assert (out[52].text, out[52].n_found, out[53].text) == (None, 0, "")
    assert "8.8.4.4" not in out[54].text and len(out[54].text) < 200_030
    # equal values stay linked, other keys give other pseudonyms, and the key brings the values back
    assert out[6].text.split()[1].rstrip(",") in out[54].text
    assert pii.pseudonymized(frame, "other").where("doc_id = 0").first().text != out[0].text
    back = got.where("doc_id < 11").select("doc_id", pii.pseudonym(F.regexp_extract("text", r"(?s)say (.*?), and", 1), F.lit("k"), inverse=True).alias("v"))
    assert {r.doc_id: r.v for r in back.collect()} == dict(enumerate(values))
    plain = pii.pseudonymized(docs, "k")
    assert plain.count() == len(rows) and pii.pseudonymized(none, "k").count() == 0


def test_permutations_are_one_to_one(spark):
    numbers = spark.range(1000).select(F.lpad(F.col("id").cast("string"), 3, "0").alias("d"))
    new = numbers.select("d", pii.permuted_digits(F.col("d"), F.lit("k"), "t").alias("p"))
    assert new.select("p").distinct().count() == 1000
    assert new.where(pii.permuted_digits(F.col("p"), F.lit("k"), "t", inverse=True) != F.col("d")).count() == 0
    days = spark.sql("select date_format(d, 'yyyy-MM-dd') as d from (select explode(sequence(date'1900-01-01', date'2099-12-31')) as d)")
    assert days.select(pii.pseudonym(F.col("d"), F.lit("k")).alias("p")).distinct().count() == 73049


def test_links_that_take_the_scheme_of_the_page(spark):
    pages = spark.createDataFrame([(1, "http://bad.com/de/", ""), (2, "http://a.net/", '<a href="//BAD.com/x">'), (3, "http://b.net/", "<a href=/bad.com/x>")], "page_id long, url string, html string")
    assert {r.page_id: r.verdict for r in urlgraph.judged(pages).collect()} == {1: "block", 2: "block", 3: "allow"}


def test_link_graph_of_a_thousand_hosts(spark):
    """Verdicts against plain power iteration; what hosts without links have goes back to the seeds."""
    import numpy as np

    rng = random.Random(12)
    hosts = [f"h{i}.{rng.choice(['net', 'org', 'com'])}" for i in range(1000)]
    pages, edges, seeds = [], collections.Counter(), {"allow": collections.Counter(), "block": collections.Counter()}
    for i, h in enumerate(hosts):
        path = rng.choice(["/de/", "/fr/", "/x"])
        to = [rng.choice(hosts[: 1 + i // 2]) for _ in range(rng.choice([0, 0, 1, 3, 6]))]
        pages.append((i, f"http://{h}{path}", "".join(f'<a href="{rng.choice(["http:", "https:", ""])}//{t}/">' for t in to)))
        edges.update((h, t) for t in to if t != h)
        if h.endswith("org") or (h.endswith("com") and path == "/fr/"):
            seeds["allow"][h] += 1
        elif h.endswith("com") and path == "/de/":
            seeds["block"][h] += 1
    at = {h: i for i, h in enumerate(hosts)}
    rank = {}
    for kind in seeds:
        m = np.zeros((1000, 1000))
        for (a, b), n in edges.items():
            m[(at[b], at[a]) if kind == "allow" else (at[a], at[b])] += n
        m /= np.where(m.sum(axis=0) > 0, m.sum(axis=0), 1)
        seed = np.array([seeds[kind][h] for h in hosts]) / sum(seeds[kind].values())
        r = seed
        for _ in range(10):
            sent = 0.85 * m @ r
            r = sent + (1 - sent.sum()) * seed
        rank[kind] = r
    frame = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(4)
    got = {r.page_id: r for r in urlgraph.judged(frame).collect()}
    free = [i for i, r in got.items() if r.rule is None]
    assert {i: got[i].verdict for i in free} == {i: "block" if rank["block"][i] > rank["allow"][i] else "allow" for i in free}
    assert len({got[i].verdict for i in free}) == 2


def test_bad_rows_go_whatever_their_id(spark):
    """Rows of a null id, and one of several texts of an id, are judged by themselves."""
    rows = [(None, "of AND! tion ing and more words", 1), (None, "plain words only here", 1), (7, "of AND! tion ing and more words", 1), (7, "other plain words here", 1), (8, None, 1), (None, None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, t1 long")
    items = spark.createDataFrame([(1, "of and tion ing")], "item_id long, text string")
    assert counted(decontam.decontaminated(docs, items), "doc_id", "text") == collections.Counter((r[0], r[1]) for r in rows if "AND" not in (r[1] or ""))


def test_top_k_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk, "QUERIES", 16)
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0, 1) * rng.choice([0.01, 1, 5]) for _ in range(8)], 0) for i in range(1500)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, length long").repartition(6)
    assert counted(topk.top_k(frame, every=20), "query_id", "rank", "vec_id", "score") == best_products(rows, every=20)


def test_many_sources(spark):
    """As many sources as documents: each is met, and totals reach the targets."""
    rng = random.Random(5)
    rows = [(i, " ".join(["w"] * rng.randint(0, 30)), f"s{i:04d}") for i in range(700)]
    got = mixing.mixed(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4), block=4).collect()
    want = targets({s: len(t.split()) for _, t, s in rows})
    assert len(got) == 700 and all(abs(r.taken - want[rows[r.doc_id][2]]) <= 1 and r.taken <= 2 * r["size"] for r in got)


def test_copies_of_a_row_cost_no_more_than_rows(spark):
    """Five thousand copies of one row, and of a null id."""
    text = "\n".join(f"line {i % 40} of some words and more to fill it" for i in range(60))
    copies = spark.range(5000).select(F.lit(3).cast("long").alias("doc_id"), F.lit(text).alias("text")).unionAll(spark.createDataFrame([(1, text), (None, "x\n" + text)], "doc_id long, text string")).repartition(8)
    lines = collections.Counter(r.n_removed for r in linededup.line_deduplicated(copies).collect())
    assert lines[60] == 5001 and sum(lines.values()) == 5002
    spans = collections.Counter((r.doc_id, r.n_removed > 0) for r in suffixdedup.without_repeats(copies).collect())
    assert spans[3, True] == 5000 and sum(spans.values()) == 5002


def test_near_duplicates_of_many_documents(spark):
    """Recall of clusters around the similarity against all pairs that share a shingle, on 2,000 documents."""
    rng = random.Random(14)
    rows, i = [], 0
    while i < 2000:
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.randint(40, 200))]
        for _ in range(rng.choice([1, 1, 2, 5, 40])):
            words = list(base)
            for j in rng.sample(range(len(words)), rng.randint(0, max(1, len(words) // 45))):
                words[j] = f"x{i}y{j}"
            rows.append((i, " ".join(words)))
            i += 1
    sets = {i: {tuple(w[j : j + 5]) for j in range(len(w) - 4)} for i, t in rows for w in [t.split()]}
    posted = collections.defaultdict(list)
    for i, s in sets.items():
        for g in s:
            posted[g].append(i)
    shared = collections.Counter((a, b) for p in posted.values() for x, a in enumerate(p) for b in p[x + 1 :])
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for percent in (80, 85):
        parent = {i: i for i in sets}

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        links = [p for p, n in shared.items() if 100 * n >= percent * (len(sets[p[0]]) + len(sets[p[1]]) - n)]
        for a, b in links:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
        got = {r.doc_id: r.component_id for r in neardup.near_duplicates(docs, percent=percent).collect()}
        met = sum(got[a] == got[b] for a, b in links)
        assert len(links) > 1000 and met >= 0.99 * len(links)
        assert all(find(got[i]) == find(i) for i in sets)  # no false link
