"""The stages on a small corpus, each judged on its own input."""

import random

from .conftest import documents, shingles


def test_stages(spark, tmp_path):
    import corpus_pipeline as C

    rng = random.Random(7)
    vocabulary = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(800)]

    def prose(n):
        return " ".join(rng.choice(vocabulary) for _ in range(n))

    item = prose(30)
    rows = [(k, "\n".join(prose(30) for _ in range(3))) for k in range(300)]
    toxic = {k for k in range(0, 300, 9)}
    rows = [(k, t.replace(" ", " scumbag ", 4) + " moronic" if k in toxic else t) for k, t in rows]
    rows = [(k, t + "\nShared License line" if k % 5 == 0 else t) for k, t in rows]
    rows += [(400, rows[1][1]), (401, rows[1][1] + " more"), (402, prose(20) + " " + item + " " + prose(20)), (403, ""), (404, None), (405, "Shared license LINE"), (406, rows[2][1]), (406, rows[2][1])]
    docs = documents(spark, rows)
    spark.createDataFrame([(k, 1, int(k in toxic)) for k in range(300) if k % 4], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    kept, texts = {}, None
    for name, stage in C.STAGES:
        docs = stage(spark, docs, str(tmp_path)).cache()
        kept[name] = [r.doc_id for r in docs.collect()]
        if name != "packing":
            assert docs.columns == documents(spark, []).columns
        if name == "line_dedup":
            texts = {r.doc_id: (r.text, r.n_chars) for r in docs.collect()}
    assert not toxic & set(kept["toxicity"]) and len(set(kept["toxicity"])) == len({k for k, _ in rows} - toxic)
    assert sum("Shared License" in (t or "") for t, _ in texts.values()) == 1 and 405 not in texts and {403, 404} < set(texts)
    assert all(n == len(t) for t, n in texts.values() if t)
    near = kept["near_dedup"]
    assert 1 in near and not {400, 401} & set(near) and 406 not in near and {403, 404} < set(near)
    assert set(near) - set(kept["decontaminate"]) == {402}
    assert set(kept["packing"]) == set(kept["decontaminate"])
    assert len(shingles(texts[1][0], 5)) > 10
    out = C.run(spark, str(tmp_path))
    assert {r.doc_id for r in out.select("doc_id").collect()} == set(kept["packing"])
    assert C.ORACLE_SQL is None and 4 <= len(C.STAGES) <= 5


def test_odd_columns_and_empty_tables(spark, tmp_path):
    import corpus_pipeline as C

    rows = [(k, f"own{k} words of text number {k} with more\nlast {k}") for k in range(30)] + [(None, "no id"), (40, None), (41, ""), (5, "own5 words of text number 5 with more\nlast 5")]
    spark.createDataFrame([(k, 1, k % 5 == 0) for k in range(30)], "doc_id long, quality int, toxic boolean").selectExpr("doc_id", "quality", "int(toxic) AS toxic").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, "one two three four five six")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    names = ("score", "held_out", "n_lines", "kept_text", "n_dropped", "gone", "row", "node", "component_id", "kept", "times", "item_id", "gone_id", "label_id")
    docs = documents(spark, rows).selectExpr("*", *(f"7 AS {c}" for c in names))
    for name, stage in C.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        got = out.collect()
        assert all(r[c] == 7 for r in got for c in names) and {None, 40, 41} <= {r.doc_id for r in got}, name
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name
