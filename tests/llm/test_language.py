import zlib

import numpy as np

from flowlens.llm import language_id as L


def test_grams_stay_in_words():
    g, n = L.grams_of(["Ab--c défg", "", "x", "abcd"])
    texts = [int(x).to_bytes(4, "little") for x in g]
    assert n.tolist() == [1 + 0 + 0 + 4, 0, 0, 3] and texts[-3:] == [b" abc", b"abcd", b"bcd "]
    assert texts[0] == b" ab " and " déf"[:3].encode() == texts[1]


def test_filter_has_no_misses_and_corrects_false_hits():
    rng = np.random.default_rng(0)
    sets = {f"l{i:02d}": rng.integers(0, 1 << 32, 3000, dtype=np.uint64).astype(np.uint32) for i in range(70)}
    m = L.build_model(sets, 16)
    for i, (k, v) in enumerate(sorted(sets.items())):
        s = L._slots(v, 16)
        assert all(((m.table[x, i // 64] >> np.uint64(i % 64)) & np.uint64(1)).all() for x in s)
    fresh = rng.integers(0, 1 << 32, 20000, dtype=np.uint64).astype(np.uint32)
    s = L._slots(fresh, 16)
    both = m.table[s[0], 0] & m.table[s[1], 0]
    for i in range(5):
        assert abs(((both >> np.uint64(i)) & np.uint64(1)).mean() - m.false_rates[i]) < 0.01


def test_edge_cases(spark):
    rows = [(1, "the cat and the dog", "en"), (2, "der hund und die katze", "de"), (3, None, "en"), (4, "", "de"),
            (5, "123 !!", "en"), (6, "the dog", None), (None, "die katze", "de"), (1, "the cat and the dog", "en"),
            (7, "the " * 40000, None)]
    df = spark.createDataFrame([(*r, "z", 9) for r in rows], "doc_id long, text string, lang string, lang_pred string, score int")
    m = L.fit(df)
    got = L.predict(df, m).collect()
    assert len(got) == len(rows)
    by = {r.text: (r.lang_pred, r.score) for r in got}
    assert by["the dog"][0] == "en" and by["die katze"][0] == "de" and by["the " * 40000][0] == "en"
    assert by[None] == by[""] == by["123 !!"] == ("und", 0.0)
    assert all(0 <= r.score <= 1 for r in got)
    kept = L.keep_known(df, m)
    assert kept.columns == df.columns and kept.count() == 6 and {r.lang_pred for r in kept.collect()} == {"z"}
    none = L.fit(df.limit(0))
    assert {r.lang_pred for r in L.predict(df, none).collect()} == {"und"}
    assert L.predict(df.limit(0), m).count() == 0


def test_query_accuracy_on_held_out_documents(spark):
    import __spark_entry__ as E
    from conftest import SF_MID
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF_MID}/documents.parquet").collect()}
    got = E.queries()["op6_language_id"](spark, SF_MID).collect()
    assert len(got) == len(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in held) >= 0.98 * len(held)


def test_numbers_are_no_letters(spark):
    from flowlens.llm.language_id import has_letter, predict
    assert not any(map(has_letter, ["", " 12 ", "½ ² Ⅷ ①", "!?_", "\u0301"])) and all(map(has_letter, ["½ a", "ß", "字", "ª"]))
    model = L.build_model({"de": np.arange(1, 50), "en": np.arange(40, 90)})
    df = spark.createDataFrame([(1, "½ ² 3"), (2, "Ⅷ ①"), (3, "wort ½")], "doc_id long, text string")
    got = {r.doc_id: r.lang_pred for r in predict(df, model).collect()}
    assert got[1] == got[2] == "und" and got[3] != "und"
