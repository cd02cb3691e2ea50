import json

import pytest

from quillstone import scorers
from quillstone.sources import formats as S


def put(tmp_path, name, text):
    p = tmp_path / name
    p.write_text(text, encoding="utf-8")
    return str(p)


def rows(df):
    return [r.asDict(recursive=True) for r in df.collect()]


def test_fasta(spark, tmp_path):
    p = put(tmp_path, "a.fasta", ">one first\nacd\nEF g\n>two|x\n\n> three\nMKV>\n")
    assert rows(S.fasta(spark, p)) == [{"header": "one first", "id": "one", "sequence": "ACDEFG"}, {"header": "three", "id": "three", "sequence": "MKV>"}]
    assert len(rows(S.fasta(spark, p, longest=5))) == 1
    S.write_fasta(S.fasta(spark, p).limit(1), str(tmp_path / "out"), "header", "sequence")
    assert rows(S.fasta(spark, str(tmp_path / "out"))) == rows(S.fasta(spark, p))[:1]


def test_lines_and_families(spark, tmp_path):
    assert [r["sequence"] for r in rows(S.sequence_lines(spark, put(tmp_path, "s", "# c\nac d\n\nEF\n")))] == ["ACD", "EF"]
    got = rows(S.families(spark, put(tmp_path, "f.tsv", "#c\nF1\tC1\tcn\tn\tdesc\tmore\n\nshort\tline\n")))
    assert got == [{"family_id": "F1", "clan_id": "C1", "clan_name": "cn", "name": "n", "description": "desc"}]


def test_blocks(spark, tmp_path):
    p = put(tmp_path, "x.sto", "# STOCKHOLM 1.0\n#=GF ID  one\n#=GF AC  PF1.2\nseq1 ACD\nseq2 A-D\n//\n#=GF ID two\n#=GF AC PF2.1\ns AA\n//\n")
    assert rows(S.stockholm(spark, p, "PF1")) == [{"accession": "PF1.2", "id": "one", "alignment": ["seq1 ACD", "seq2 A-D"]}]
    assert len(rows(S.stockholm(spark, p))) == 2
    q = put(tmp_path, "p.dat", "ID   SITE_A; PATTERN.\nAC   PS1;\nDE   Some\nDE   site.\nPA   N-{P}-\nPA   [ST].\n//\nID   NOPE; RULE.\nAC   PS2;\n//\n")
    assert rows(S.prosite(spark, q)) == [{"ID": "SITE_A", "AC": "PS1", "DE": "Some site", "PA": "N-{P}-[ST]", "CC": ""}]


@pytest.mark.parametrize("separator", ["\t", ",", ";"])
def test_sniffed(spark, tmp_path, separator):
    text = "﻿a b" + separator + "'q'\n1" + separator + "'x y'\n\"2\"" + separator + "z\n"
    assert rows(S.sniffed(spark, put(tmp_path, "t", text))) == [{"a b": "1", "q": "x y"}, {"a b": "2", "q": "z"}]


def test_reactions(spark, tmp_path):
    p = put(tmp_path, "r.tsv", "Reaction identifier\tEquation\tEC number\tUniProt\nR1\tA = B\tEC:1; EC:2\t12\nR2\tC = D\t\tmany\n")
    assert rows(S.reactions(spark, p)) == [{"reaction_id": "R1", "equation": "A = B", "ecs": ["EC:1", "EC:2"], "n_proteins": 12}, {"reaction_id": "R2", "equation": "C = D", "ecs": [], "n_proteins": None}]


def test_json(spark, tmp_path):
    p = put(tmp_path, "c.json", json.dumps([{"accession": "a", "sequence": " ac\nd "}, {"accession": "b", "sequence": None}, {"accession": "c", "sequence": "", "score": 1}]))
    assert rows(S.candidates(spark, p)) == [{"accession": "a", "sequence": "ACD", "score": None}]
    assert rows(S.candidates(spark, str(tmp_path / "none.json"))) == []
    lines = [{"index": 0, "first_user": "hello", "final_dialog": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]}, {"index": 1, "first_user": json.dumps([{"role": "system", "content": "s"}, {"role": "user", "content": "u"}]), "final_dialog": []}, {"index": 2, "first_user": None, "final_dialog": [{"role": "user", "content": "q2"}]}]
    d = rows(S.dialogs(spark, put(tmp_path, "d.jsonl", "\n".join(map(json.dumps, lines)) + "\n\n")))
    assert [(r["first_user"], r["last_message"]) for r in d] == [("hello", "a"), ("u", None), ("q2", "q2")]
    with pytest.raises(Exception):
        S.json_lines(spark, put(tmp_path, "bad.jsonl", '{"index": 1}\n{"index": \n'), S.TRAJECTORY).collect()


def test_structures(spark, tmp_path):
    atom = "ATOM  {:>5} {:<4} {:>3} {}{:>4}    {:>8.3f}{:>8.3f}{:>8.3f}{:>6.2f}{:>6.2f}\n"
    text = "HEADER\n" + "".join(atom.format(i, "CA", "ALA", "A", pos, 0, 0, 0, 1, b) for i, (pos, b) in enumerate([(1, 50), (1, 70), (1000, 90)]))
    assert sorted((r["position"], r["confidence"]) for r in rows(S.pdb_confidence(spark, put(tmp_path, "x.pdb", text)))) == [(1, 60.0), (1000, 90.0)]
    got = rows(S.hmm_header(spark, put(tmp_path, "x.hmm", "HMMER3/f [x]\nNAME  fam\nACC   PF1\nHMM  A C\n  1 2\n")))
    assert {r["tag"]: r["value"] for r in got} == {"HMMER3/f": "[x]", "NAME": "fam", "ACC": "PF1"}


def test_tables(spark, tmp_path):
    a, b = spark.createDataFrame([(1, "x")], "i int, s string"), spark.createDataFrame([(2, 2.5)], "i int, d double")
    board = str(tmp_path / "board")
    S.append_board(a, board)
    S.append_board(b, board)
    assert sorted((r["i"], r["s"], r["d"]) for r in rows(spark.read.parquet(board))) == [(1, "x", None), (2, None, 2.5)]
    S.overwrite(spark.read.parquet(board).filter("i = 2"), board)
    assert [r["i"] for r in rows(spark.read.parquet(board))] == [2]
    assert len(rows(S.parquet_union(spark, board, board))) == 2
    S.write_csv(spark.createDataFrame([(2, 'q"uo\nte'), (1, "b")], "i int, s string"), str(tmp_path / "csv"), "i")
    assert [(r["i"], r["s"]) for r in rows(S.csv_table(spark, str(tmp_path / "csv"), "i int, s string"))] == [(1, "b"), (2, 'q"uo\nte')]
    v = spark.createDataFrame([(1, "p", [1.0]), (2, "q", [2.0])], "row_id long, modality string, vector array<double>")
    for _ in range(2):
        S.write_vectors(v, str(tmp_path / "v"), "modality")
    assert spark.read.parquet(str(tmp_path / "v")).count() == 2


def test_scorers(spark):
    df = spark.createDataFrame([("a", "b"), ("a", None)], "q string, s string")
    got = [r["score"] for r in rows(scorers.scored(df, scorers.HashScorer("q", "s")))]
    assert len(set(got)) == 2 and all(0 <= x <= 20 for x in got)
    scorers.register("hash", scorers.HashScorer("q"))
    scorers.register("hash", scorers.HashScorer("s"))
    assert scorers.named("hash_2").columns == ("s",)


def test_append_documents(spark, tmp_path):
    at = str(tmp_path / "rounds")
    rows = lambda *n: spark.createDataFrame([(f"a{i}", float(i)) for i in n], "accession string, score double")
    S.append_documents(rows(1, 2), at)
    S.append_documents(rows(3), at)
    S.append_documents(rows(), at)
    got = S.json_documents(spark, at, rows().schema)
    assert sorted(tuple(r) for r in got.collect()) == [("a1", 1.0), ("a2", 2.0), ("a3", 3.0)]


def test_append_to_damaged(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "part.json").write_text("no list")
    S.append_documents(spark.createDataFrame([("a", 1.0)], "accession string, score double"), str(tmp_path / "x"))
    assert S.json_documents(spark, str(tmp_path / "x"), "accession string, score double").count() == 1


def test_numbered(spark, tmp_path):
    (tmp_path / "s.fa").write_text("".join(f">p{i}\nAC{'G' * i}\n" for i in range(9)))
    rows = S.numbered(S.fasta(spark, str(tmp_path / "s.fa"), 8)).orderBy("ordinal").collect()
    assert [(r["ordinal"], r["id"]) for r in rows] == [(i, f"p{i}") for i in range(7)]


def test_vectors(spark, tmp_path):
    v = spark.createDataFrame([(1, "seq", "a", [1.0]), (2, "text", "a", [2.0]), (3, "text", "b", [3.0])], "row_id long, modality string, subsection string, vector array<double>")
    S.write_vectors(v.filter("row_id < 3"), str(tmp_path / "v1"), "modality", "subsection")
    S.write_vectors(v.filter("row_id = 3"), str(tmp_path / "v2"), "modality", "subsection")
    both = [str(tmp_path / "v1"), str(tmp_path / "v2")]
    assert sorted(r["row_id"] for r in S.vectors(spark, *both).collect()) == [1, 2, 3]
    assert [r["row_id"] for r in S.vectors(spark, *both, modality=["text"], subsection=["b"]).collect()] == [3]
