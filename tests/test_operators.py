import difflib
import random
import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillstone.functions import seq as S
from quillstone.functions import text as T
from quillstone.operators import constraints, intervals, lookups, ranking, retrieval, search, sequences, summary
from quillstone.operators import sessions as R
from quillstone.operators import trajectory as J
from quillstone.plans import rules


def rows(df, *columns):
    return sorted(tuple(r[c] for c in (columns or df.columns)) for r in df.collect())


def plain_tandem(s, longest=20, copies=3):
    hit = set()
    for w in range(1, min(longest, len(s) // 2) + 1):
        for i in range(len(s) - w * copies + 1):
            k = 1
            while s[i + k * w : i + (k + 1) * w] == s[i : i + w]:
                k += 1
            if k >= copies:
                hit.update(range(i, i + k * w))
    return len(hit) / len(s) if s else 0.0


@settings(max_examples=200, deadline=None)
@given(st.text("abc", max_size=40))
def test_tandem_share(s):
    """A partial last copy also counts here; so the share is at least that of whole copies, and equal without partial ones."""
    got, want = float(sequences.tandem_shares(["aaa", s, None, s])[1]), plain_tandem(s)
    assert want - 1e-9 <= got <= 1 and (want > 0) == (got > 0)


@settings(max_examples=100, deadline=None)
@given(st.text("abcd", max_size=12), st.text("abcd", max_size=12))
def test_local_identity(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    assert sequences.local_identity_of(a, b) == (t[-1][-1] / min(len(a), len(b)) if a and b else 0.0)


@pytest.mark.parametrize("pattern", ["A", "[ST]x?B{2}", "(AB|CD)E+", "[^A].C{0,3}", "^M(A){3}$", "R[A-C]{2,4}?T"])
def test_shortest_match(pattern):
    assert re.search(pattern, sequences.shortest_match(pattern))


def test_vectorised_functions(spark):
    df = spark.createDataFrame([("Hello world", "hallo word"), (None, "x"), ("", ""), ("a" * 250, "ab" * 120)], "a string, b string").coalesce(1)
    got = [r[0] for r in df.select(sequences.fuzzy_ratio("a", "b")).collect()]
    want = [difflib.SequenceMatcher(None, a.lower(), b.lower()).ratio() for a, b in (("Hello world", "hallo word"), ("", ""), ("a" * 250, "ab" * 120))]
    assert got == [want[0], None, want[1], want[2]]
    for text in ("aaab", "", None, "baab aa", "xyz", "aaaaaa", "b"):
        got = [tuple(x)[1:] for x in spark.createDataFrame([(text,)], "s string").select(sequences.pattern_spans(F.col("s"), ["aa", "(bad", "a*", "^b", "[^a]+", "a|b"])).first()[0]]
        assert got == [(p, m.start(), m.end()) for p in ("aa", "a*", "^b", "[^a]+", "a|b") for m in re.finditer(p, text or "") if m.group()]


def test_text_functions(spark):
    one = spark.range(1)
    val = lambda c: one.select(c.alias("x")).first()[0]
    lit = F.lit
    assert val(T.tag_body(lit("a <Answer>\n x <b> \n</ANSWER>"), "answer")) == "x <b>" and val(T.tag_body(lit("<answer> </answer>"), "answer")) is None
    assert val(T.labelled_number(lit("global_best: 19.4."), "global_best")) == 19.4 and val(T.labelled_number(lit("global_best: none"), "global_best")) is None
    assert val(T.after_last(lit("Mark: a mark: b"), "MARK:")) == " b" and val(T.after_last(lit("none"), "mark:")) is None
    assert val(T.before_first(lit("abc stop def end"), ["end", "stop"])) == "abc " and val(T.before_first(lit("abc"), ["end"])) == "abc"
    assert val(T.first_filled(lit(None).cast("string"), lit(" "), lit("x"))) == "x"
    assert val(T.slug(lit("Ünï code/ Name "))) == "n-code-name" and val(T.slug(lit("///"))) == "unknown"
    assert val(T.py_literal_field(lit("{'ground_truth': 'AC', 'x': None}"), "ground_truth")) == "AC"
    assert val(T.py_literal_field(lit('{"ground_truth": "AC"}'), "ground_truth")) == "AC" and val(T.py_literal_field(lit("nothing"), "ground_truth")) is None
    assert val(T.keyword_match(lit("A big Red dog"), '"red dog" cat|big')) and not val(T.keyword_match(lit("A big dog"), "red")) and val(T.keyword_match(lit("x"), ""))
    assert val(S.pattern_to_regex(lit("<A-{PG}-x(2)-[ST](1,3)-C>."))) == "^A[^PG].{2}[ST]{1,3}C$"
    assert val(S.longest_run(lit(""))) == 0 and val(S.longest_run(lit("abbbcc"))) == 3
    assert val(S.insert_at(lit("abcd"), lit(2), lit("XY"))) == "abXYcd"
    assert val(S.validity_reason(lit("ACDX"), 2, 9, 3)) == "alphabet" and val(S.validity_reason(lit("AAAA"), 2, 9, 3)) == "run"


def test_merged_intervals(spark):
    rng = random.Random(4)
    for gap in (0, 1):
        for _ in range(8):
            spans = [(s, s + rng.randint(1, 6)) for s in (rng.randint(0, 60) for _ in range(rng.randint(0, 12)))]
            a = F.array(*[F.struct(F.lit(s).alias("s"), F.lit(e).alias("e")) for s, e in spans]) if spans else F.array().cast("array<struct<s:int,e:int>>")
            got = [tuple(x) for x in spark.range(1).select(S.merged(a, gap)).first()[0]]
            cover = {p for s, e in spans for p in range(s, e)}
            assert {p for s, e in got for p in range(s, e)} >= cover and all(x[1] + gap < y[0] for x, y in zip(got, got[1:]))
            if not gap:
                assert {p for s, e in got for p in range(s, e)} == cover
            df = spark.createDataFrame([(1, s, e) for s, e in spans], "k int, s int, e int")
            assert rows(intervals.merge(df, ["k"], "s", "e", gap), "s", "e") == got


def test_overlaps(spark):
    rng = random.Random(1)
    make = lambda: [(rng.randint(0, 2), s, s + rng.randint(0, 90)) for s in (rng.randint(0, 300) for _ in range(40))]
    a, b = make(), make()
    got = rows(intervals.overlaps(spark.createDataFrame(a, "k int, ls int, le int"), spark.createDataFrame(b, "k int, rs int, re int"), ["k"], 16), "k", "ls", "le", "rs", "re")
    assert got == sorted((k, s, e, s2, e2) for k, s, e in a for k2, s2, e2 in b if k == k2 and max(s, s2) < min(e, e2))


@pytest.mark.parametrize("parts", [1, 4, 16])
def test_results_do_not_depend_on_partitions(spark, parts):
    df = spark.createDataFrame([(i, i % 3, i * 7 % 11, [float(i % 5), float(i % 7) + 1]) for i in range(60)], "id long, g int, score int, vector array<double>").repartition(parts)
    ids = lambda x, *c: rows(x, *c)
    best = sorted((i,) for g in range(3) for i in sorted((i for i in range(60) if i % 3 == g), key=lambda i: (-(i * 7 % 11), i))[:2])
    assert ids(ranking.top_k(df, ["g"], 2, F.desc("score"), "id"), "id") == best
    assert [r[0] for r in ids(ranking.with_ordinal(df, "id", width=7), "id", "ordinal")] == [r[1] for r in ids(ranking.with_ordinal(df, "id", width=7), "id", "ordinal")]
    assert [n for _, n in ids(ranking.equal_shards(df, "id", 7).groupBy("shard").count())] == [9] * 6 + [6]
    near = retrieval.nearest(df.filter("id % 20 = 0"), df, 3)
    full = sorted(((sum(a * b for a, b in zip((q % 5, q % 7 + 1), (i % 5, i % 7 + 1))), -i), q) for q in (0, 20, 40) for i in range(60) if i != q)
    want = sorted((q, -i) for q in (0, 20, 40) for _, i in sorted((x for x, k in full if k == q), reverse=True)[:3])
    assert ids(near, "query_id", "id") == want
    drawn = lookups.negatives(df.filter("id < 5").select(F.col("id").alias("q"), "id"), df, "q", "id", 8, seed=1)
    assert drawn.groupBy("q").agg(F.countDistinct("negative")).collect() and {r[1] for r in ids(drawn.groupBy("q").agg(F.countDistinct("negative").alias("n")))} == {8}
    assert ids(drawn, "q", "negative") == test_results_do_not_depend_on_partitions.__dict__.setdefault("drawn", ids(drawn, "q", "negative"))


def test_keep_first_last_and_merge(spark):
    df = spark.createDataFrame([("a", 1, 5.0), ("a", 2, 9.0), ("b", 3, None)], "k string, o int, score double")
    assert rows(ranking.keep_first(df, ["k"], "o"), "k", "o") == [("a", 1), ("b", 3)]
    assert rows(ranking.keep_last(df, ["k"], "o"), "k", "o", "first_place") == [("a", 2, 1), ("b", 3, 3)]
    new = spark.createDataFrame([("a", 7, 99.0), ("c", 8, 6.0)], "k string, o int, score double")
    assert rows(ranking.merge_top_k(ranking.keep_first(df, ["k"], "o"), new, ["k"], 2, "score"), "k", "score") == [("a", 5.0), ("c", 6.0)]
    assert rows(lookups.new_rows(df.select("k", "score"), spark.createDataFrame([("b", None)], "k string, score double"), ["k", "score"]), "k") == [("a",), ("a",)]


def test_worst_fill(spark):
    df = spark.createDataFrame([(1.0, True, True), (None, True, True), (5.0, False, True), (float("nan"), False, True), (9.0, True, False)], "m double, ok boolean, used boolean")
    mean = lambda smaller: summary.worst_fill_mean(df, {"m": smaller}, F.col("ok"), F.col("used")).first()[0]
    assert mean(True) == (1 + 9 + 9 + 9) / 4 and mean(False) == 1.0
    assert summary.worst_fill_mean(df.limit(0), {"m": True}, F.col("ok"), F.col("used")).first()[0] is None


def test_ranking_quality(spark):
    df = spark.createDataFrame([("q", 1, False), ("q", 2, True), ("q", 3, True), ("q", 4, False), ("n", 1, False)], "q string, rank int, relevant boolean")
    assert rows(retrieval.ranking_quality(df, "q", "rank", "relevant")) == [("n", 0.0, 0.0, 0.0, 0), ("q", (1 / 2 + 2 / 3) / 2, 0.5, 0.5, 2)]


def test_rewards(spark):
    e = spark.createDataFrame([("s", i, "find", ok, v) for i, (ok, v) in enumerate([(True, 16.0), (True, 11.0), (False, None), (True, 1.0), (True, 2.0)])], "user string, o int, tool string, success boolean, score double")
    mild, capped = J.reward_mild(e, "user").first(), J.reward_capped(e, "user", ["o"], F.col("tool") == "find").first()
    assert round(mild["r_tools"], 6) == round(0.6 + 0.45 - 0.1 + 0.3 + 0.3, 6) and round(mild["reward"], 6) == round(mild["r_tools"] + 0.4, 6)
    assert round(capped["r_tools"], 6) == round(0.9 - 0.1, 6) and capped["n_stage"] == 4


def test_sessions(spark):
    e = spark.createDataFrame([("s", 1, "a", 3.0), ("s", 1, "b", 4.0), ("s", 2, "a", 9.0), ("s", 3, "c", 6.0)], "session string, round int, candidate string, score double")
    assert rows(R.rounds(e), "round", "n_new", "best", "delta") == [(1, 2, 4.0, 4.0), (2, 0, 4.0, 0.0), (3, 1, 6.0, 2.0)]
    assert rows(R.pool(e, 2), "candidate", "score") == [("b", 4.0), ("c", 6.0)]


def test_search(spark):
    docs = spark.createDataFrame([(1, "the red dog"), (2, "the cat"), (3, "a red cat sat"), (4, None)], "id int, text string")
    q = spark.createDataFrame([(9, "red cat"), (8, "zebra"), (7, "green cat")], "q int, text string")
    assert rows(search.cascade(docs, "id", q, "q", "text"), "q", "id", "level") == [(7, 2, 3), (7, 3, 3), (9, 3, 1)]
    assert rows(search.best_matches(search.bm25(docs.filter("text is not null"), "id", q, "q", "text"), "id", "q", 1), "q", "id") == [(7, 2), (9, 3)]


def test_constraints(spark):
    df = spark.createDataFrame([("k", 1, ["a", "b"], None, "x"), ("k", 2, ["b", "c"], "h", "y"), ("k", 3, None, "i", None)], "k string, o int, l array<string>, f string, m string")
    assert rows(constraints.merged_documents(df, "k", "o", ["l"], ["f"], ["m"]), "k", "l", "f", "m") == [("k", ["a", "b", "c"], "h", "y")]
    val = lambda c: spark.range(1).select(c).first()[0]
    assert val(constraints.min_count_ok(F.lit("AACC"), [(9, 3, "C", 2), (1, 2, "A", 2)])) and not val(constraints.charge_ok(F.lit("KKKK"), [(1, 4, None, 3)]))
    assert val(constraints.cleavage_fixed(F.lit("MKTLLLDEPKWL"))) == "MKTLLLAAAAWA" and val(constraints.cleavage_fixed(F.lit("MK"))) == "MK"


def test_stream_is_like_batch(spark):
    sf = "/root/testdata/sf0.001"
    stream = rows(rules.stream_session_topk(spark, sf), "user_id", "event_id", "rank")
    e = spark.read.parquet(f"{sf}/events.parquet").filter("user_id is not null and value is not null")
    assert stream == rows(ranking.top_k(e, ["user_id"], 3, F.desc("value"), "event_id"), "user_id", "event_id", "rank")


def test_local_identity_of_long_and_wide_texts():
    rng = random.Random(3)
    a, b = ("".join(rng.choices("ACDEFGHIKLMNPQRSTVWY", k=10_000)) for _ in range(2))
    began = time.process_time()
    assert 0.3 < sequences.local_identity_of(a, b) < 0.45
    assert time.process_time() - began < 0.5
    assert sequences.local_identity_of(a, a[:7000]) == 1.0 and sequences.local_identity_of("é😀x", "😀") == 1.0 and sequences.local_identity_of("\ud800a", "b\ud800") == 0.5
    assert sequences.local_identity_of("", "a") == 0.0


INDEX = [("C..C", "zinc finger site"), ("", "zinc zinc"), ("H", "Heme, site of iron"), ("K", "site")]


def plain_hits(hint, most=3):
    """The score by its definition, in the order of the index."""
    q = (hint or "").strip(" ").lower()
    scored = []
    for i, (pattern, told) in enumerate(INDEX):
        words = set(re.split("[^a-z0-9]+", told.lower()))
        score = 5 * (q in told.lower()) + sum(w in words for w in re.split("[^a-z0-9]+", q) if w)
        if pattern and score:
            scored.append((-score, i))
    return sorted(scored)[:most]


def test_text_hits(spark):
    hints = [None, "", " ZINC ", "heme site site", "nothing here", "iron-site", "zinc finger site", "finger\nzinc zinc", "Site"]
    df = spark.createDataFrame([(i, h) for i, h in enumerate(hints)], "i int, hint string")
    got = {r.i: [(x.order, x.i) for x in r.hits] for r in df.select("i", sequences.text_hits(F.col("hint"), INDEX).alias("hits")).collect()}
    assert got == {i: plain_hits(h) for i, h in enumerate(hints)}


def test_exemplars(spark):
    df = spark.createDataFrame([("a", "KKGX"), ("a", "G"), ("a", None), ("b", ""), (None, "R")], "class string, seq string")
    got = {(r["class"]): (r.n, r.kr, r.g) for r in sequences.exemplars(df, "class", "seq", {"kr": "KR", "g": "G"}).collect()}
    assert got == {"a": (3, 0.4, 0.4), "b": (1, None, None), None: (1, 1.0, 0.0)}


def test_pair_entropy_by_hand(spark):
    import math
    from collections import Counter

    from quillstone.operators.sequences import pair_entropy

    texts = ["ABAB", "A", "", None, "ZZZZ", "漢字漢字x", "ab" * 3000 + "c"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, s string").coalesce(1)
    for r in df.select("i", pair_entropy("s").alias("e")).collect():
        s = texts[r["i"]] or ""
        n = Counter(s[k : k + 2] for k in range(len(s) - 1))
        want = -sum(v / n.total() * math.log(v / n.total() + 1e-9) for v in n.values()) if n else None
        assert r["e"]["n_kmers"] == len(n) and (r["e"]["entropy"] is None) == (want is None)
        assert want is None or abs(r["e"]["entropy"] - want) < 1e-9
