"""Chains of rules against plain expectations; the query itself is held against its SQL in test_queries."""

from pyspark.sql import functions as F

from quillstone.operators import chains
from quillstone.operators import constraints as C

INDEX = [("C.{2}C", "zinc finger"), ("K[ST]{2}", "PLP site"), ("[DE]{3}", "calcium ring")]
SEQ = "MKSSGGACDECHHDEEDDAAGGAVKLMNPQRSTVWY"


def documents(spark, rows):
    df = spark.createDataFrame(rows, "id long, seq string, asked string, locked array<int>, has_base boolean")
    empty = F.lit(None)
    base = F.when(F.col("has_base"), chains.fragment(F.array(F.lit("K")), F.array(F.lit("[DE]{6,}")), empty, F.array(F.lit("AAA")), F.lit(7)))
    out = chains.cofactor_documents(df, "id", F.col("seq"), F.col("asked"), F.col("locked"), base, INDEX, win=8, step=4)
    return {r["id"]: r for r in out.collect()}


def test_parts_fold_in_order(spark):
    r = documents(spark, [(1, SEQ, "Zinc;  heme   c ,, zinc", [], True)])[1]
    assert r["n_parts"] == 3 and r["detected"] == "zn" and not r["auto_used"]
    # The base first, then the class's rules, then the motifs found, the longest first and earlier patterns first; nothing twice.
    assert r["allow"] == ["K", "C.{2,4}C", "H.{2,5}H", "C.{2,4}H", "H.{2,4}C", "C.{2}C", "K[ST]{2}", "[DE]{3}"]
    assert r["forbid"][0] == "[DE]{6,}" and len(set(r["forbid"])) == len(r["forbid"])
    assert r["motifs"] == ["AAA", "", "CXXC", "CXXCH"]
    assert r["most_cys"] == 7
    assert len({tuple(x) for x in r["rules"]}) == len(r["rules"])


def test_first_writer_bounds_and_empty_cases(spark):
    rows = documents(spark, [(1, SEQ, "4Fe-4S", None, False), (2, None, "ATP", None, False), (3, SEQ, None, [0], True), (4, "", " ,;", None, False), (5, "GK", "NADP+", [0, 1, 1, 99, -3], None)])
    assert rows[1]["most_cys"] == 12 and rows[1]["first"] is None
    assert rows[2]["detected"] == "atp_gtp" and rows[2]["auto_used"] and (rows[2]["first"], rows[2]["last"]) == (1, 8)
    assert rows[3]["allow"] == ["K"] and rows[3]["n_parts"] == 0 and rows[3]["detected"] is None
    assert rows[4]["allow"] == [] and rows[4]["most_cys"] is None
    assert rows[5]["overlap"] == 2


def test_windows_measured_once_equal_those_of_one_desire(spark):
    rows = [(i, (SEQ * (i % 7))[i % 5 :], [x for x in range(i % 3, 300, 1 + i % 11)], ("DE", "CH", "FWY", "G", "")[i % 5]) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, seq string, locked array<int>, desire string")
    plain = F.coalesce(*[F.when(F.col("desire") == x, C.best_window(F.col("seq"), 16, 4, x, F.col("locked"))) for x in ("DE", "CH", "FWY", "G", "")])
    got = df.select(plain.alias("want"), C.best_measured(C.measured_windows(F.col("seq"), 16, 4, F.col("locked")), 16, 4, F.col("desire")).alias("got")).collect()
    assert all(tuple(r["want"]) == tuple(r["got"]) for r in got)


def test_windows_of_many_sequences_equal_those_of_one(spark, monkeypatch):
    rows = [(i, (SEQ * (i % 9))[i % 5 :][: (0, 1, 15, 16, 17, 400)[i % 6]], [*range(i % 3 - 4, 300, 1 + i % 11), i, None]) for i in range(60)] + [(60, "\U0001f600\u00e9K" * 30, [])]
    df, wanted = spark.createDataFrame(rows, "id int, seq string, locked array<int>"), ["DE", "FWY", "", "G", "CH"]
    monkeypatch.setattr(C, "LETTERS", 500)
    for size, step in ((16, 4), (64, 7), (5, 5)):  # 64 has scores that end in a half
        once = F.array_distinct(F.filter("locked", lambda p: (p >= 0) & (p < F.greatest(F.length("seq"), F.lit(size)))))
        plain = F.array(*[C.best_window(F.col("seq"), size, step, x, once) for x in wanted])
        got = df.select(plain.alias("want"), C.best_windows(F.col("seq"), size, step, F.array(*map(F.lit, wanted)), F.col("locked")).alias("got")).collect()
        assert all(list(map(tuple, r["want"])) == list(map(tuple, r["got"])) for r in got)


def test_windows_are_not_scored_by_lambdas(spark):
    from quillstone.plans.chains import chained_rules

    plan = chained_rules(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "ArrowEvalPython" in plan and r"((.)\2*)" not in plan and "Exchange" not in plan


def test_rules_for_the_whole_of_an_empty_sequence(spark):
    rows = documents(spark, [(1, "", "heme c", None, False), (2, None, "ATP", None, False), (3, "A", "heme c", None, False)])
    ends = lambda r, kind: [(x["first"], x["last"]) for x in r["rules"] if x["kind"] == kind]
    assert ends(rows[1], "prefer") == [(1, 0)] and ends(rows[3], "prefer") == [(1, 1)]
    assert ends(rows[2], "max_hydropathy") == [(1, 8), (1, 0)]


def test_query_equals_its_sql_on_odd_texts(spark, tmp_path):
    import duckdb

    from quillstone.plans.chains import ORACLES, chained_rules

    texts = [None, "", " ,; 12 \u00e9", "a", "abcdefghijklmno", "abcdefghijklmnop", "CAACGKTHAAHKSSDDDGAGAAG", "K gagaag\nCxxC"]
    rows = [(i, t, "en", "x", n) for i, (n, t) in enumerate((n, t) for n in (None, *range(0, 256, 9), 2, 3, 4) for t in texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    cur = con.execute(ORACLES["chained_rules"])
    names = [d[0] for d in cur.description]
    want = sorted(tuple(map(str, r)) for r in cur.fetchall())
    assert sorted(tuple(str(r[c]) for c in names) for r in chained_rules(spark, str(tmp_path)).collect()) == want


def test_resolution_against_plain_python(spark):
    """The whole query over the small tables, by loops over rows."""
    import re

    import duckdb

    from quillstone.operators.motifs import class_score
    from quillstone.operators.sequences import shortest_match
    from quillstone.plans.chains import CLASSES, FORBID, motif_resolution

    d = "/root/testdata/sf0.001"
    docs = [(i, re.sub("[^A-Za-z]", "", t or "").upper()) for i, t in duckdb.sql(f"select doc_id, text from '{d}/documents.parquet'").fetchall()]
    places = {c[0]: [(m.start() - m.end(), i, m.start(), m.group()) for i, s in docs for m in re.finditer(c[3], s)] for c in CLASSES}
    broken = lambda s: any(re.search(p, s) for p in FORBID)

    def resolve(text):
        scored = sorted((-round(class_score(text, name, about, len(places[c])), 6), c, p) for c, name, about, p in CLASSES)
        scored = [x for x in scored if -x[0] >= 0.2][:8]
        if not scored:
            return None, None, None
        real = [(c, min(places[c])[3]) for _, c, _ in scored if places[c] and set(min(places[c])[3]) <= set("ACDEFGHIKLMNPQRSTVWY")]
        motif, source = (real[0][1], "instance") if real else (shortest_match(scored[-1][2]), "pattern")
        if broken(motif):
            fixes = [next((f for f in (motif[:i] + r + motif[i + 1 :] for r in "QNSTG") if not broken(f)), None) for i, c in enumerate(motif) if c == "A"]
            motif = ([f for f in fixes if f] or [motif])[-1]
        return real[0][0] if real else None, motif, source

    want = {k: (*resolve(f"{name} {kind}"), size) for k, name, kind, size in duckdb.sql(f"select p_partkey, p_name, p_type, p_size from '{d}/part.parquet'").fetchall()}
    rows = motif_resolution(spark, d).collect()
    assert len(rows) == len(want) and {r["source"] for r in rows} >= {"instance"}
    for r in rows:
        c, motif, source, size = want[r["p_partkey"]]
        had = ["CAAC"] if size % 2 == 0 else ["KSSG"]
        assert (r["class"], r["motif"], r["source"]) == (c, motif, source)
        assert r["motifs"] == ",".join(had + [motif] * (motif is not None and motif not in had))


def test_blocks_of_classes_do_not_change_the_ranking(spark, monkeypatch):
    from quillstone.operators import motifs

    classes = spark.createDataFrame([(f"c{i}", f"name {i % 4}", "about this", i * 10) for i in range(12)], "class string, name string, about string, n int")
    asked = spark.createDataFrame([("name 1",), ("about",), ("name 1",), (None,), ("",)], "t string")
    ranked = lambda: sorted(map(tuple, motifs.best_classes(asked, "t", classes, k=3).collect()))
    whole = ranked()
    monkeypatch.setattr(motifs, "BLOCK", 8)
    assert ranked() == whole and len(whole) >= 6


def test_last_repair_and_patterns(spark):
    from quillstone.functions import design as D
    from quillstone.operators.sequences import shortest_matches

    r = spark.createDataFrame([("AAGA",), ("AGAGA",), ("KK",), ("",), (None,)], "s string").select(D.last_repair(F.col("s"), ["GA", "KK"]).alias("x")).collect()
    assert [x[0] for x in r] == ["AAGQ", "AGAGA", "KK", "", None]
    p = spark.createDataFrame([("[DE]{3}K",), ("(",), (None,)], "p string").select(shortest_matches("p").alias("x")).collect()
    assert [x[0] for x in p] == ["DDDK", None, None]
