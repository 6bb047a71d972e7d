import random
import re

import numpy as np
import pytest

from threadloom.llm import encode, language, leakage, neighbours, split


# --- nearest vectors ---


def brute(ids, x, k):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(u @ u.T, 12)
    out = {}
    for i in range(len(ids)):
        order = sorted((-s[i, j], ids[j]) for j in range(len(ids)) if j != i)[:k]
        out[ids[i]] = [b for _, b in order]
    return out


def test_neighbours_with_copies_and_gaps(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 16))
    x = (centres[rng.integers(12, size=300)] + 0.05 * rng.normal(size=(300, 16))).astype(np.float32)
    x[200:260] = x[0]  # one vector with many copies
    rows = [(i, [float(v) for v in x[i]], "e") for i in range(300)] + [(900, None, ""), (901, [0.0] * 16, ""), (902, [1.0], ""), (903, [float("nan")] * 16, "")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, extra string")
    want = brute(list(range(300)), x.astype(np.float64), 5)
    for block in (16, 2048):
        got = {}
        for r in neighbours.nearest_neighbours(df, per_list=32, block=block).collect():
            got.setdefault(r["id"], {})[r["rank"]] = r["neighbour"]
        assert set(got) == set(want)
        hit = sum(len(set(got[i].values()) & set(want[i])) for i in want) / (5 * len(want))
        assert hit >= 0.98
        assert [got[250][r] for r in range(1, 6)] == want[250]


@pytest.mark.parametrize("noise", [0.0, 1e-7, 1e-4])
def test_neighbours_of_scaled_copies_and_dense_groups(spark, noise):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(2400, 16))
    x[rng.permutation(2400)[:2000]] = x[7]
    x = ((x + noise * rng.normal(size=x.shape)) * rng.uniform(0.2, 5, size=(2400, 1))).astype(np.float32)
    df = spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in range(2400)], "vec_id long, embedding array<float>")
    want = brute(list(range(2400)), x.astype(np.float64), 5)
    got = {}
    for r in neighbours.nearest_neighbours(df).collect():
        got.setdefault(r["id"], {})[r["rank"]] = r["neighbour"]
    hit = sum([got[i].get(r) for r in range(1, 6)] == want[i] for i in want)
    dense = np.round((x / np.linalg.norm(x, axis=1, keepdims=True)) @ (x[7] / np.linalg.norm(x[7])), 3) > 0.99
    assert all([got[i].get(r) for r in range(1, 6)] == want[i] for i in np.flatnonzero(dense))
    assert hit >= 0.93 * 2400  # the others are spread evenly, where lists not probed hold some


def test_neighbours_ties_within_a_block():
    score = np.array([[1.0, 0.5, 1.0, 1.0, 0.7], [0.1, 0.2, 0.2, 0.3, 0.2]])
    assert neighbours.best_of(score, 2).tolist() == [[0, 2], [1, 3]]
    assert neighbours.best_of(score, 9).tolist() == [[0, 1, 2, 3, 4]] * 2


def test_neighbours_small_and_empty(spark):
    schema = "vec_id long, embedding array<float>"
    assert neighbours.nearest_neighbours(spark.createDataFrame([], schema)).count() == 0
    two = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], schema)
    assert {tuple(r) for r in neighbours.similar_pairs(neighbours.nearest_neighbours(two)).collect()} == {(1, 2)}


# --- splitting ---

TOKEN = re.compile(r"[^\W]+")


def pieces(spark, texts, limit=20, overlap=5):
    df = spark.createDataFrame([(i, t, 100, "x") for i, t in enumerate(texts)], "chunk_key long, text string, source_start int, piece string")
    out = {}
    for r in sorted(split.split_oversized(df, limit=limit, overlap=overlap).collect(), key=lambda r: (r["chunk_key"], r["piece_no"])):
        out.setdefault(r["chunk_key"], []).append(r)
    return out


def test_split_properties(spark):
    rng = random.Random(4)
    texts = [None, "", "   ", "one two three", "a " * 20, ("w" * 50 + " ") * 21, "." * 9000, "x. " * 200 + "\n\n" + "y\r\n" * 50, "😀 ünï " * 40]
    for _ in range(20):
        texts.append("".join(rng.choice(["word ", "w_1, ", "end. ", "\n", "\n\n", "--- ", "über "]) for _ in range(rng.randrange(200))))
    got = pieces(spark, texts)
    assert 0 not in got
    for i, t in enumerate(texts):
        if t is None:
            continue
        ps, n = got[i], len(TOKEN.findall(t))
        assert (len(ps) > 1) == (n > 20)
        assert ps[0]["piece_start"] == 0 and ps[-1]["piece_end"] == len(t)
        for p in ps:
            assert p["piece_text"] == t[p["piece_start"] : p["piece_end"]]
            assert p["piece_token_count"] == len(TOKEN.findall(p["piece_text"])) <= 20
            assert p["piece_source_start"] == 100 + p["piece_start"]
        for a, b in zip(ps, ps[1:]):
            assert a["piece_start"] < b["piece_start"] <= a["piece_end"] < b["piece_end"]
            assert 1 <= len(TOKEN.findall(t[b["piece_start"] : a["piece_end"]])) <= 5


def test_split_prefers_paragraphs_and_sentences(spark):
    text = "one two three four five six seven eight nine ten eleven twelve.\n\nthirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty twentyone twentytwo"
    ps = pieces(spark, [text])[0]
    assert ps[0]["piece_text"].endswith("twelve.\n\n")
    with pytest.raises(ValueError):
        pieces(spark, ["x"], 5, 5)


# --- encoding ---


def test_encoding_round_trip_and_offsets(spark):
    texts = [None, "", "Hello <|endoftext|> wörld 😀👩‍🔧\x00\r\n", "a" * 20000, "日本語 text", "  \t"]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    got = {r["doc_id"]: list(r["ids"]) for r in encode.encode(df).collect()}
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(encode.DEFAULT_VOCABULARY)
    plain.encode_special_tokens = True
    for i, t in enumerate(texts):
        assert got[i] == plain.encode(t or "", add_special_tokens=False).ids
    assert got[0] == [] and got[1] == [] and 50256 not in got[2]
    spans = encode.encode_with_offsets(df)
    for r in spans.withColumn("back", encode.decode(spans["ids"])).collect():
        t = texts[r["doc_id"]] or ""
        assert r["back"] == t
        raw = t.encode()
        assert [b["start"] for b in r["byte_spans"]][1:] == [b["end"] for b in r["byte_spans"]][:-1]
        for c, b in zip(r["char_spans"], r["byte_spans"]):
            assert raw[b["start"] : b["end"]] in t[c["start"] : c["end"]].encode()
    odd = spark.createDataFrame([([999999],), (None,), ([],)], "ids array<int>")
    assert [r[0] for r in odd.select(encode.decode(odd["ids"])).collect()] == [None, None, ""]


# --- leakage ---

ITEM = "The auditor counted the sealed manifest at the old silo on Monday. Nobody has seen the second key since March, reference Kelpmast 31. The ferry company asked for a new lease of the hall."


def test_leaks(spark):
    ws = ITEM.split()
    altered = " ".join(w if i % 9 else "thing" for i, w in enumerate(ws))
    moved = " ".join(ws[20:]) + " Other words stand here between the parts of it. " + " ".join(ws[:20])
    docs = [(1, "Before. " + ITEM + " After."), (2, altered), (3, moved), (4, "The auditor counted the boxes at the old silo, and nobody has seen them."), (5, None), (6, ""), (7, "short"), (8, "> " + ITEM.replace(". ", ".\n> ")), (9, "word " * 50000)]
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, item_id string")
    items = spark.createDataFrame([(1, "Quote the sentence of the mail that settles the question. " + ITEM), (2, "Quote the sentence of the mail that settles the question. Blue lamps."), (3, None)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in leakage.leaks(df, items).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (8, 1)}
    assert leakage.leaks(df.limit(0), items).count() == 0 and leakage.leaks(df, items.limit(0)).count() == 0


def test_tiles_are_greedy_and_disjoint():
    a, b = np.array([1, 2, 3, 4, 5, 6, 7, 8]), np.array([5, 6, 7, 8, 0, 1, 2, 3, 4])
    assert sorted(leakage.tiles(a, b)) == [(0, 5, 4), (4, 0, 4)]
    rng = random.Random(0)
    for _ in range(50):
        a, b = (np.array([rng.randrange(4) for _ in range(40)]) for _ in range(2))
        found = leakage.tiles(a, b)
        assert all((a[i : i + n] == b[j : j + n]).all() for i, j, n in found)
        for k in (0, 1):
            used = [x for t in found for x in range(t[k], t[k] + t[2])]
            assert len(used) == len(set(used))
        assert [n for *_, n in found] == sorted((n for *_, n in found), reverse=True)


# --- languages ---

EN = ["The landlord signed the lease of the hall on Monday.", "Nobody has seen the second key of the old silo.", "We still need the list of the missing boxes before Friday.", "The night shift counted the damaged pallets again."]
DE = ["Der Vermieter hat den Vertrag für die Halle am Montag unterschrieben.", "Niemand hat den zweiten Schlüssel zum alten Silo gesehen.", "Wir brauchen noch die Liste der fehlenden Kisten vor Freitag.", "Die Nachtschicht hat die beschädigten Paletten noch einmal gezählt."]


def test_languages(spark):
    rng = random.Random(3)
    make = lambda xs: " ".join(rng.sample(xs, 3))
    rows = [(i, make(EN), "en-US" if i % 9 else "de") for i in range(40)] + [(100 + i, make(DE), ["de", "deu", "German", None][i % 4]) for i in range(40)]
    rows += [(200, EN[0] + "\n\n" + DE[1], "EN"), (201, None, "en"), (202, "  ", None), (203, "job=1 ms=2\nFrom: Ann Lee\nSubject: Plan", "de"), (204, EN[1], "sv")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, confidence string")
    model = language.fit(df)
    found = language.document_languages(language.segments(df, model))
    got = {(r["doc_id"], r["lang"]) for r in language.mislabelled(df, found).collect()}
    want = {(i, "en") for i in range(40) if i % 9 == 0} | {(100 + i, "de") for i in range(40) if i % 4 == 3} | {(200, "en"), (200, "de"), (204, "en")}
    assert got == want
    assert language.mislabelled(df.limit(0), language.document_languages(language.segments(df.limit(0), model))).count() == 0


def test_sentences_undo_wraps_and_skip_noise():
    text = "From: Ann Lee\n> The night shift\n> counted the pal-\n> lets again. Yes.\n2033-01-01T00:00:00Z INFO job=1\n\nno stop here"
    assert [s for _, _, s in language.sentences(text)] == ["The night shift counted the pallets again."]
    a, b, _ = language.sentences(text)[0]
    assert text[a:b].startswith("The night") and text[a:b].endswith("again.")


def test_leaks_of_short_items(spark):
    eight = "purple herons circled above twelve quiet brick chimneys"
    other = "green lanterns hung along the narrow canal while seven drummers marched past the shuttered bakery and the crowd sang old songs until dawn came"
    part = " ".join(other.split()[5:16])  # 11 of 25 words
    common = "please let me know by friday whether the boxes are there"
    items = spark.createDataFrame([(1, eight), (2, other), (3, common), (4, common + " or not"), (5, "two words"), (6, None)], "item_id long, text string")
    docs = [(1, f"Before it {eight} after it."), (2, f"They said {part} again."), (3, "Please let me know by Friday."), (4, " ".join(other.split()[:3])), (5, "two words")]
    got = {(r["doc_id"], r["item_id"]) for r in leakage.leaks(spark.createDataFrame(docs, "doc_id long, text string"), items).collect()}
    assert got == {(1, 1), (2, 2)}


def test_leaks_do_not_depend_on_the_size_of_blocks(spark, monkeypatch):
    items = spark.createDataFrame([(i, f"{ITEM} Number {i} of the list stands in room {i + 3} beside bench {i * 7}.") for i in range(6)], "item_id long, text string")
    docs = spark.createDataFrame([(1, ITEM), (2, "Number 4 of the list stands in room 7 beside bench 28. " * 2)], "doc_id long, text string")
    found = lambda: {tuple(r) for r in leakage.leaks(docs, items).collect()}
    whole = found()
    monkeypatch.setattr(leakage, "BLOCK_WORDS", 60)
    assert found() == whole


def test_language_dictionaries_read_whole_texts(spark):
    rng = random.Random(5)
    texts = [(i, " ".join(rng.sample(EN, 3)), "en") for i in range(30)] + [(100 + i, " ".join(rng.sample(DE, 3)), "de") for i in range(30)]
    filler = "-----\n" * 1400  # the sentences stand after 8,000 characters
    fit = lambda rows: language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string")).content
    short = fit(texts)
    assert short and fit([(i, filler + t, c) for i, t, c in texts]) == short
