import pytest
from pyspark.sql import functions as F

from sigtrace.llm import mixing as M
from sigtrace.llm.queries import mix

TARGETS = "mix_name string, source string, target_share double, max_repeats int"


def docs_of(spark):
    rows = [(i, "word " * (5 + i % 40), "Big Source") for i in range(400)] + [(1000 + i, "tiny text " * 20, " big-SOURCE " if i % 2 else "tiny") for i in range(30)]
    rows += [(2000, None, "tiny"), (2001, "", "tiny"), (2002, "x y", None), (2003, "no target", "other")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_counts_agree_with_the_tokenizer(spark):
    import tiktoken

    import base64

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(M.TOKENIZER, "rb"))}
    enc = tiktoken.Encoding("t", pat_str=M.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = ["Hello world", "它's 12", "", None, "<|endoftext|>", "a" * 5000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.n_tokens for r in M.token_counts(df, keep=("doc_id",)).collect()}
    assert got == {i: len(enc.encode_ordinary(t or "")) for i, t in enumerate(texts)}


def test_shares_repeats_and_order(spark):
    targets = spark.createDataFrame([("m", "big_source", 0.6, 2), ("m", "TINY", 0.3, 4), ("m", "missing", 0.1, 4), ("none", "missing", 1.0, 1), ("zero", "tiny", 0.0, 3), ("m", None, 0.5, 1)], TARGETS)
    got = M.mix_sources(docs_of(spark), targets)
    shares = {(r.mix_name, r.source): r for r in got.shares.collect()}
    big, tiny = shares["m", "big_source"], shares["m", "tiny"]
    assert big.reached_share == pytest.approx(2 / 3, abs=0.01) and tiny.reached_share == pytest.approx(1 / 3, abs=0.01)
    assert tiny.most_copies == 4 and big.most_copies <= 2 and shares["m", "missing"].tokens == 0 and shares["zero", "tiny"].tokens == 0
    copies = got.copies.toPandas()
    assert (copies.groupby(["mix_name", "doc_id", "copy_no"]).size() == 1).all() and copies.position.between(0, 1).all()
    ordered = got.ordered.toPandas()
    assert ordered.position.is_monotonic_increasing and len(ordered) == len(copies)
    # sources that may be repeated more often come later
    half = copies[copies.position < 0.5].groupby("source").n_tokens.sum() / copies.groupby("source").n_tokens.sum()
    assert half["tiny"] < 0.5 < half["big_source"]


def test_given_size_is_held_by_repeats(spark):
    targets = spark.createDataFrame([("m", "big_source", 0.5, 1), ("m", "tiny", 0.5, 2)], TARGETS)
    got = {r.source: r for r in M.mix_sources(docs_of(spark), targets, total_tokens=8000).shares.collect()}
    assert got["tiny"].most_copies == 2 and got["tiny"].tokens == 2 * got["tiny"].available
    assert got["big_source"].tokens == pytest.approx(4000, abs=60)


def test_schedules_are_integrated_and_inverted(spark):
    """Positions follow a piecewise linear schedule: the tokens up to each time are its integral."""
    rows = [("m", "big_source", 0.0, 0.0), ("m", "Big source", 0.5, 2.0), ("m", "big_source", 1.0, 0.0), ("m", "tiny", 0.25, 0.0), ("m", "tiny", 0.5, 1.0), ("m", "tiny", -1.0, 9.0), ("x", "tiny", 0.0, 0.0)]
    schedules = spark.createDataFrame(rows, "mix_name string, source string, at double, weight double")
    targets = spark.createDataFrame([("m", "big_source", 0.5, 2), ("m", "tiny", 0.5, 2)], TARGETS)
    copies = M.mix_sources(docs_of(spark), targets, schedules=schedules).copies.toPandas()
    w = {"big_source": lambda t: 2 * t if t < 0.5 else 2 - 2 * t, "tiny": lambda t: 0 if t < 0.25 else 4 * t - 1 if t < 0.5 else 1}
    for source, g in copies.groupby("source"):
        g = g.sort_values("position")
        steps = 20000
        area = [0.0]
        for i in range(steps):
            area.append(area[-1] + w[source]((i + 0.5) / steps))
        for at, done in list(zip(g.position, (g.n_tokens.cumsum() - g.n_tokens) / g.n_tokens.sum()))[::7]:
            assert area[int(at * steps)] / area[-1] == pytest.approx(done, abs=0.02)
    assert copies[copies.source == "tiny"].position.min() >= 0.25


def test_large_documents_do_not_spoil_small_mixes(spark):
    """One document is larger than its source's demand: smaller ones fill it instead."""
    docs = spark.createDataFrame([(i, "word " * n, "a") for i, n in enumerate([900, 70, 61, 53, 31, 17, 9, 5, 3, 2])] + [(100 + i, "word " * 20, "b") for i in range(50)], "doc_id long, text string, source string")
    targets = spark.createDataFrame([("m", "a", 0.2, 1), ("m", "b", 0.8, 1)], TARGETS)
    got = M.mix_sources(docs, targets)
    shares = {r.source: r for r in got.shares.collect()}
    assert shares["a"].reached_share == pytest.approx(0.2, abs=0.004) and shares["b"].most_copies == 1 and shares["a"].most_copies == 1
    c = got.copies.toPandas()
    assert not c.duplicated(["doc_id", "copy_no"]).any() and 0 not in set(c.doc_id)


def test_prefix_sums(spark):
    d = spark.range(5000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("source"), (F.col("id") % 7).alias("n_tokens"))
    p = M.before_each(d, "source", "n_tokens", "doc_id", 1).toPandas().sort_values(["source", "_before", "n_tokens"])
    for _, g in p.groupby("source"):
        ends = g._before + g.n_tokens
        assert g._before.iloc[0] == 0 and ends.max() == g.n_tokens.sum() and sorted(g._before[1:]) == sorted(ends)[:-1]


def test_empty_and_real(spark, data):
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    targets = spark.createDataFrame([("m", "a", 1.0, 1)], TARGETS)
    assert M.mix_sources(empty, targets).copies.count() == 0 and M.mix_sources(docs_of(spark), targets.limit(0)).copies.count() == 0
    over = mix(spark, data).shares.filter("most_copies > max_repeats").count()
    assert over == 0
