from threadloom.llm import scans as S

SCHEMA = "page_key long, attachment_id string, filename string, page_no int, text string, ocr_used boolean, extra string"
CLEAN = "The contractor signed the contract at the mountain station. The auditor counted the half-finished manifest after the second delivery. " * 3


def found(spark, rows):
    r = S.Repair(spark.createDataFrame(rows, SCHEMA))
    return {tuple(x) for x in r.found().collect()}, {(x["page_key"], x["paragraph"]): x["text"] for x in r.text().collect()}


def test_repairs(spark):
    one = "Annual Report\n\nThe c0ntractor signed the contract at the moun-\ntain station. The auditor countcd the half-\nfinished manifest after 1,2O4 days. The mani-\n\nPage 1 of 2"
    two = "Annual Report\n\nfest of the sccond delivery.\n\nPage 2 of 2"
    rows = [(1, "a", "annual_report.pdf", 1, one, True, ""), (2, "a", "annual_report.pdf", 2, two, None, ""), (9, "c", "x.pdf", 1, CLEAN, False, ""), (8, None, None, None, None, None, ""), (7, None, None, 1, " \n", True, "")]
    got, text = found(spark, rows)
    assert got == {
        (1, 6, "furniture", ""), (2, 0, "furniture", ""), (2, 4, "furniture", ""),
        (1, 2, "hyphen", "mountain"), (1, 3, "hyphen", "half-finished"), (1, 4, "hyphen", "manifest"),
        (1, 2, "misread", "contractor"), (1, 3, "misread", "counted"), (1, 4, "misread", "1,204"), (2, 2, "misread", "second"),
    }
    assert text[(1, 1)] == "The contractor signed the contract at the mountain station. The auditor counted the half-finished manifest after 1,204 days. The manifest"
    assert text[(2, 1)] == "of the second delivery."


def test_empty(spark):
    got, text = found(spark, [])
    assert got == set() and text == {}


def test_numbers_variants_and_page_numbers():
    assert S.repaired_number("3I,843") == "31,843" and S.repaired_number("word") is None and S.repaired_number("12") is None
    assert S.reading("+hat", "that")[0] == "that" and S.reading("cIerk", "clerk")[0] == "clerk" and S.reading("dehvered", "delivered")[0] == "delivered"
    assert S.reading("Ha1f-flnished", "half-finished")[0] == "Half-finished" and S.reading("house", "mouse") is None and S.reading("word", "word") is None
    assert S.page_number("Seitc 3 von S", 3) and S.page_number("- iii -", 3) and not S.page_number("3071", 3) and not S.page_number("Page proofs", 3)
    assert S.skeleton("Marnbleridge H@ndbook") != "" and S.skeleton("Haridbook") == S.skeleton("Handbook")


def test_viterbi_uses_neighbours():
    ws = [{"pos": 0, "token": "the", "starts": True, "own": 0, "cands": []}, {"pos": 1, "token": "cast", "starts": False, "own": 8, "cands": [{"word": "east", "channel": -0.7, "n": 100, "lower": True}]}]
    assert S.decode_line(ws, [{"first": "the", "second": "east", "n": 50}]) == ["the", "east"]


def test_page_order_over_blank_and_missing_pages(spark):
    rows = [(1, "a", "x.pdf", 1, "Here ends the moun-", True, ""), (2, "a", "x.pdf", 2, " ", True, ""), (3, "a", "x.pdf", 3, "tain road of the town", True, ""), (4, "a", "x.pdf", 5, "A last broken wo-", True, ""), (9, "b", "y.pdf", None, "No number for this moun-", True, ""), (10, "b", "y.pdf", None, "tain page", True, ""), (8, "c", "z.pdf", 1, "mountain road", False, "")]
    got, text = found(spark, rows)
    assert {g for g in got if g[2] == "hyphen"} == {(1, 0, "hyphen", "mountain")}
    assert text[(3, 0)] == "road of the town"


def test_page_ends_over_many_blank_and_missing_pages(spark):
    page = lambda key, no, text: (key, "a", "x.pdf", no, text, True, "")
    rows = [page(1, 1, "Here ends the moun-"), page(2, 2, " "), page(3, 3, None), page(4, 4, "\n"), page(5, 5, "tain road of the con-"), page(6, 9, "tractor in the town"), (8, "c", "z.pdf", 1, "mountain road of the contractor", False, "")]
    got, text = found(spark, rows)
    assert {g for g in got if g[2] == "hyphen"} == {(1, 0, "hyphen", "mountain"), (5, 0, "hyphen", "contractor")}
    assert text[(5, 0)].startswith("road of the") and text[(6, 0)] == "in the town"


def test_stroke_keys_survive_every_confusion(spark):
    """Each entry of both tables, alone and with others, leaves a word in reach of its reading."""
    import random

    rng, rows = random.Random(2), []
    for o, ts in [*S.HARD.items(), *S.SOFT.items()]:
        for t in ts:
            for _ in range(3):
                a, b = ("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(4)) for _ in range(2))
                rows.append((a + o + b, (a + t + b).lower()))
    df = spark.createDataFrame(rows, "token string, word string")
    got = df.select("token", "word", S.F.arrays_overlap(S.stroke_keys(df["token"]), S.stroke_keys(df["word"])).alias("met")).collect()
    assert all(r["met"] for r in got), [r for r in got if not r["met"]][:5]


def test_words_with_many_signs_and_long_words(spark):
    long = "hafenbehördenzulassungsbescheinigungsnummernverzeichnis"
    clean = f"Possibilities abound. The possibilities of the {long} and the collection of libraries. " * 4
    page = f"The p0551b111+1e5 of the {long.replace('u', 'ii', 2).replace('e', 'c', 3)} are open to the c0llcction"
    got, _ = found(spark, [(1, "a", "x.pdf", 1, page, True, ""), (2, "b", "y.pdf", 1, clean, False, "")])
    assert got == {(1, 0, "misread", w) for w in ("possibilities", long, "collection")}
