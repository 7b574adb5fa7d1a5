from scarp.plans import candidates


def test_front_structure_and_no_fragments(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(candidates, "FRONT", 3)
    rows = [
        (1, "A", 0.9, 0.9, 0.1, 0.5, "c1;c2"),
        (2, "A", 0.9, 0.9, 0.1, 0.4, "c1;c2"),  # the structure of 1
        (3, "B", 0.1, 0.1, 0.05, 0.99, "c9"),  # dominated, but the best score
        (4, "C", 0.1, 0.2, 0.9, 0.3, None),  # on the front, without fragments
        (5, None, 0.5, 0.95, 0.2, 0.2, "c3"),
        (6, "D", 0.05, 0.05, 0.01, 0.1, "c4"),
    ]
    spark.createDataFrame(rows, "hit_id long, smiles string, qsar double, sa double, qed double, score double, fragments string").write.parquet(str(tmp_path / "hits.parquet"))
    got = {r.hit_id: r.pick for r in candidates.diverse_hits(spark, str(tmp_path)).collect()}
    assert set(got) == {1, 4, 5} and got[1] == 1
