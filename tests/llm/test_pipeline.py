"""The corpus pipeline stage by stage on a planted corpus."""
import random

import corpus_pipeline
from robustlens.llm import passages

EN, DE = "the of and to in is that it was for with as", "der die und in den von zu das mit sich des auf"


def corpus(g):
    def prose(lang, n):
        common = (EN if lang == "en" else DE).split()
        return [g.choice(common) if g.random() < 0.4 else "".join(g.choices("tionaer" if lang == "en" else "schungei", k=7)) for _ in range(n)]

    leak, passage, rows = prose("en", 30), prose("de", 70), {}
    for i in range(150):
        lang = "en" if i % 3 else "de"
        rows[i] = (" ".join(prose(lang, g.randrange(60, 200))), lang, f"s{i % 4}")
    base = rows[7][0].split()
    base[10] = "edited"
    rows[200] = (" ".join(base), "en", "s0")                     # near copy of 7
    rows[201] = (rows[8][0], "en", "s1")                          # copy of 8
    for i in (30, 33, 36):
        rows[i] = (rows[i][0] + "\n" + " ".join(passage) + "\nende", "de", "s1")
    for i in (50, 52):
        w = rows[i][0].split()
        w[20:20] = leak if i == 50 else [*leak[:12], "swapped", *leak[13:]]
        rows[i] = (" ".join(w), "en", "s2")
    rows[300], rows[301], rows[302] = ("12345 !!", "en", "s0"), ("", "en", "s0"), (None, None, None)
    return rows, " ".join(leak), passage


def test_stages_in_turn(spark, tmp_path):
    rows, leak, passage = corpus(random.Random(1))
    spark.createDataFrame([(i, *r, len(r[0] or "")) for i, r in rows.items()], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, leak), (1, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        new = stage(spark, docs, str(tmp_path))
        assert k == 4 or new.columns == docs.columns
        new.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        kept[name] = {r.doc_id: r for r in docs.collect()}
    assert set(rows) - set(kept["language"]) == {300, 301, 302}
    assert set(kept["language"]) - set(kept["near_duplicates"]) == {200, 201}
    assert set(kept["passages"]) == set(kept["near_duplicates"])
    changed = {i for i, r in kept["passages"].items() if r.text != rows[i][0]}
    assert {33, 36} <= changed <= {33, 36, 52} and all(" ".join(passage) not in kept["passages"][i].text for i in changed) and " ".join(passage) in kept["passages"][30].text
    assert all(r.n_chars == len(r.text) for r in kept["passages"].values())
    assert set(kept["passages"]) - set(kept["decontamination"]) >= {50} and set(kept["passages"]) - set(kept["decontamination"]) <= {50, 52}
    mixed = kept["mixing"]
    assert set(mixed) == set(kept["decontamination"]) and len({(r.mix_slot, r.mix_pos) for r in mixed.values()}) == len(mixed)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "passages", "decontamination", "mixing"] and passages.STRETCH == 24


def test_run_equals_the_stages(spark, sf_dir):
    got = corpus_pipeline.run(spark, sf_dir)
    assert got.count() > 100 and {"doc_id", "text", "lang", "source", "n_chars", "mix_slot"} <= set(got.columns)


def test_clashing_columns_and_empty_tables(spark):
    from robustlens.llm import mixing, passages
    words = "it is said that the people of the town were not there when the long day came to an end and that they had all gone away from us"
    rows = [(i, f"{words} {words} number {i % 2}", "en", "s", 1, "mine", 2.5, "g", {"a": 1}) for i in range(6)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, lang_pred string, score double, __gone string, m map<string,int>"
    docs = spark.createDataFrame(rows, schema)
    named = corpus_pipeline.language_stage(spark, docs, None)
    assert named.columns == docs.columns and {(r.lang_pred, r.score) for r in named.collect()} <= {("mine", 2.5)}
    cut = passages.drop_repeats(docs)
    assert cut.columns == docs.columns and {r["__gone"] for r in cut.collect()} == {"g"}
    assert sorted(r.doc_id for r in mixing.mix(docs).collect()) == list(range(6))
    none = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        if name != "decontamination":
            assert stage(spark, none, None).count() == 0
