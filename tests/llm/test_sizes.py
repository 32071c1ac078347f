"""What operators shuffle and keep at a time, on small tables."""

import pytest

from tests.llm.test_operators import made_up, table


def test_keys_of_near_copies_are_shuffled_in_shares(spark, monkeypatch):
    from sealbook.llm import jaccard
    from sealbook.operators.durable import Scratch

    shares, keep = [], Scratch.keep

    def seen(self, df):
        kept = keep(self, df)
        if kept.columns == ["key", "id", "hub"]:
            shares.append({r.key for r in kept.collect()})
        return kept

    monkeypatch.setattr(jaccard.Scratch, "keep", seen)
    rows = made_up(9) + [(1000 + k, " ".join(f"w{i}" for i in range(60)) + f" x{k}") for k in range(30)]
    found = jaccard.near_duplicates(table(spark, rows), words=3, num=80).collect()
    assert {r.component_id for r in found if r.doc_id is not None and r.doc_id >= 1000} == {1000}
    assert len(shares) > 1 and sum(map(bool, shares)) > 1
    assert len(set().union(*shares)) == sum(map(len, shares))


def test_token_blocks_are_not_shuffled_to_be_read(spark, tmp_path, capsys):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from pathlib import Path

    from sealbook.llm.token_files import read_token_files, write_token_files

    write_token_files(table(spark, made_up(9)), str(tmp_path / "t"), Path(public_tokenizers.path("byte_bpe_50k.json")).read_text())
    most = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        tokens = read_token_files(spark, str(tmp_path / "t"))
        assert tokens.count() == len(made_up(9))
        capsys.readouterr()
        tokens.explain()
        assert "SortMergeJoin" not in capsys.readouterr().out
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", most)


def test_texts_go_to_workers_once(spark):
    from sealbook.llm.decontamination import without_contaminated
    from sealbook.llm.toxicity import without_toxic

    rows = [(k, "you idiot moron stupid trash" if k % 2 else "a fine calm day", k) for k in range(40)] + [(None, None, 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, more long")
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, toxic int")
    benchmark = spark.createDataFrame([(1, "a sentence of the benchmark that stands in no document")], "item_id long, text string")
    for kept, n in ((without_toxic(docs, labels), 21), (without_contaminated(docs, benchmark), 41)):
        plan = kept._jdf.queryExecution().analyzed().toString()
        sent = next(line for line in plan.split("\n")[::-1] if "AS row#" in line)
        assert sent.count("text#") == 1, sent
        assert kept.columns == docs.columns and kept.count() == n
    as_number = docs.withColumn("text", docs["doc_id"])
    assert sorted(map(str, without_contaminated(as_number, benchmark).collect())) == sorted(map(str, as_number.collect()))
