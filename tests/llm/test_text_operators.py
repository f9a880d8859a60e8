"""Language, main content, scanned pages, spam: accuracy where it can be told, and the edges."""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from corvella.llm import block_training, language, main_content, scan_repair, spam_pages, spam_training
from tests.conftest import DATA

# language


@pytest.fixture(scope="module")
def samples():
    rows = pd.read_parquet(DATA / "lang_samples.parquet")
    return list(zip(rows.lang, rows.text))


def test_language_held_out(samples):
    rng = random.Random(1)
    mixed = samples[:]
    rng.shuffle(mixed)
    model = language.WordFirst(mixed[:150])
    scorer = language._Scorer(model)
    found = language._analyse([t for _, t in mixed[150:]], scorer)
    right = sum({model.languages[s[2]] for s in f} == {lang} for f, (lang, _) in zip(found, mixed[150:]))
    assert right >= 0.97 * len(found)
    pairs = [(a, b) for a in mixed[150:] for b in mixed[150:] if a[0] != b[0]][:100]
    both = language._analyse([f"{a[1]} {b[1]}" for a, b in pairs], scorer)
    assert sum({model.languages[s[2]] for s in f} == {a[0], b[0]} for f, (a, b) in zip(both, pairs)) >= 0.9 * len(pairs)


def test_language_edges(spark, samples):
    model = language.WordFirst(samples)
    de, en = next(t for x, t in samples if x == "de"), next(t for x, t in samples if x == "en")
    rows = [(1, None, "x"), (2, "", "x"), (3, " \n\t", "x"), (4, "12 345 / 6", "x"), (5, en + " (Ventil)", "x"), (6, de * 2000, "x"), (7, en, "x"), (7, en, "x"), (8, f"{de}\n{en}", "x"), (9, "qz8x/7kk+zz9/p0w3", "x")]
    df = spark.createDataFrame(rows, "id int, body string, stretch string")
    got = {}
    for r in language.language_stretches(df, "body", ["id"], model).collect():
        got.setdefault(r.id, []).append((r.lang, r.start_at, r.end_at, r.confidence))
    assert set(got) == {5, 6, 7, 8}
    assert [x[0] for x in got[5]] == ["en"] and {x[0] for x in got[6]} == {"de"} and len(got[7]) == 2
    assert [x[0] for x in sorted(got[8], key=lambda x: x[1])] == ["de", "en"]
    assert all(0 < x[3] <= 1 for v in got.values() for x in v)
    assert language.language_stretches(df.limit(0), "body", ["id"], model).count() == 0


def test_labels(spark):
    rows = [("en-US", "en"), (" en ", "en"), ("English", "en"), ("ger", "de"), ("de-AT", "de"), ("français", "fr"), ("Español", "es"), ("العربية", "ar"), ("und", None), ("n/a", None), ("", None), (None, None), ("it", None)]
    df = spark.createDataFrame(rows, "label string, want string").withColumn("got", language.label_language(F.col("label")))
    assert df.where("NOT (got <=> want)").count() == 0


# main content


def test_labeller_agrees_with_teacher(spark):
    assets = pd.read_parquet(DATA / "assets.parquet")
    chunks = pd.read_parquet(DATA / "chunks.parquet", columns=["chunk_id", "chunk_asset_id", "chunk_text"])
    texts = chunks[chunks.chunk_asset_id.isin(assets.asset_id[assets.asset_type == "url"])].chunk_text.tolist()
    pages = block_training.labelled_pages(texts)
    labeller = main_content.BlockLabeller.load()
    p = labeller.scores(labeller.projected(np.concatenate([x for x, _ in pages])), [len(y) for _, y in pages]) >= 0.5
    y = np.concatenate([y for _, y in pages]) > 0
    assert len(y) > 200 and np.mean(p == y) >= 0.97


def test_gradient_is_right():
    rng = np.random.default_rng(0)
    H, size = main_content.HIDDEN, main_content.INPUT
    a = {"wx": rng.standard_normal((2, size, 4 * H)) * 0.1, "wh": rng.standard_normal((2, H, 4 * H)) * 0.1, "b": np.zeros((2, 4 * H)), "wo": rng.standard_normal(2 * H), "bo": np.zeros(())}
    x, y, mask = rng.standard_normal((2, 3, size)), np.array([[1.0, 0, 1], [0, 1, 0]]), np.array([[1.0, 1, 1], [1, 1, 0]])
    _, g = block_training._gradient(a, x, y, mask)
    for k, at in (("wx", (0, 5, 7)), ("wx", (1, 9, 100)), ("wh", (1, 3, 50)), ("b", (0, 70)), ("wo", (4,))):
        kept = a[k][at]
        a[k][at] = kept + 1e-4
        up, _ = block_training._gradient(a, x, y, mask)
        a[k][at] = kept - 1e-4
        down, _ = block_training._gradient(a, x, y, mask)
        a[k][at] = kept
        assert abs((up - down) / 2e-4 - g[k][at]) < 1e-3 * max(1, abs(g[k][at]))


def test_one_page_at_a_time_is_the_same():
    labeller, vectors = main_content.BlockLabeller.load(), main_content.Vectors()
    texts = ["Home | Docs | Blog\n\nA sentence about the pump that was replaced last week.\nCopyright 2026 Example", "Accept all\n- one", "One line only."]
    pages = [main_content.text_blocks(t)[1] for t in texts]
    together = labeller.label([b for p in pages for b in p], [len(p) for p in pages], vectors)
    alone = np.concatenate([labeller.label(p, [len(p)], vectors) for p in pages])
    assert np.allclose(together, alone, atol=1e-5)


def test_main_content_edges(spark):
    article = "The night shift replaced the spare pump before the holiday, since the weir was narrow. It took the loading dock 40 days to find that the roster had been copied.\nSection 7 explains how to seal the valve block and why the price sheet is public."
    page = f"Home\nDocs\nPricing\n\n{article}\n\nAccept all\nCopyright 2026 Example – made with care"
    rows = [(1, page, "x"), (2, None, "x"), (3, "", "x"), (4, " \n ", "x"), (5, "A sentence that is long enough to be prose. " * 20_000, "x"), (6, "x\n" * 5_000, "x"), (1, page, "x")]
    df = spark.createDataFrame(rows, "id int, body string, _text string")
    lines = main_content.label_lines(df, "body", ["id"])
    assert {r.id for r in lines.select("id").distinct().collect()} == {1, 5, 6}
    assert lines.where("id = 6").count() == 5_000
    assert sorted({r.line_no for r in lines.where("id = 1 AND boilerplate >= 0.5").collect()}) == [1, 2, 3, 8, 9]
    texts = {r.id: r.main_text for r in main_content.main_text(df, "body", ["id"]).collect()}
    assert texts[1] == article
    assert texts[2] is None and texts[3] == "" and texts[4].strip() == ""
    assert main_content.label_lines(df.limit(0), "body", ["id"]).count() == 0


def test_html_paths():
    x = main_content.Vectors().matrix([(main_content.html_path(["html", "body", "nav", "ul", "li"]), "Home"), (main_content.html_path(["html", "body", "article", "p"]), "Text")])
    assert x.shape == (2, main_content.INPUT) and (x[0] != x[1]).any()


# scanned pages

COUNTS = {w: 5000 for w in "the pump was replaced before holiday by night shift and that which translate library open line work".split()} | {"open-ended": 400, "well-kept": 300}


@pytest.fixture(scope="module")
def reader():
    return scan_repair.PageReader(COUNTS)


@pytest.mark.parametrize(
    ("token", "fixed"),
    [("tbe", "the"), ("th@t", "that"), ("wbich", "which"), ("rep1aced", "replaced"), ("vvas", "was"), ("hohday,", "holiday,"), ("Tbe", "The"), ("the", "the"), ("VV-1234", "VV-1234"), ("12", "12"), ("pump!", "pump!"), ("xyzzy", "xyzzy"), ("", ""), ("...", "...")],
)
def test_token(reader, token, fixed):
    assert reader.token(token) == (fixed, token != fixed)


@pytest.mark.parametrize(
    ("left", "mark", "right", "whole", "cut"),
    [("trans", "-", "late", "translate", True), ("open", "-", "ended", "open-ended", False), ("well", "-", "kept.", "well-kept.", False), ("libr", "­", "ary", "library", True), ("tr@ns", "¬", "late", "tr@nslate", True)],
)
def test_joint(reader, left, mark, right, whole, cut):
    assert reader.joint(left, mark, right) == (whole, cut)


def test_split_and_merged_words(reader):
    assert reader.decoder.segmented("thepump") == ["the", "pump"]
    assert reader.decoder.segmented("qqqqzzzz") is None
    assert reader.repaired("the pu mp was thepump", set()) == "the pump was the pump"


JOINT = {w: 5000 for w in "the pump was replaced before of to a information inform together world old".split()}


@pytest.mark.parametrize(("text", "defects"), [("the ofthc pump", {"misread"}), ("the vvo rld was", {"misread"}), ("the\nofthc pump", {"misread"}), ("the pu mp was thepump", set()), ("old Kovacs of cxlv", set())])
def test_defects_are_edits_of_the_joint_decoding(text, defects):
    assert scan_repair.PageReader(JOINT).defects(text) == defects


@pytest.mark.parametrize(
    ("text", "whole"),
    [
        ("the inform ation was", "the information was"), ("to gether", "together"), ("the inf orma tion was", "the information was"), ("the inform\nation was", "the information was"), ("the pump wasre\nplaced", "the pump was replaced"),
        ("Thepump was apump", "The pump was a pump"), ("before thepump, ofthc.", "before the pump, of the."), ("old Kovacs of cxlv", "old Kovacs of cxlv"),
    ],
)
def test_pages_are_decoded_across_tokens_and_lines(text, whole):
    assert scan_repair.PageReader(JOINT).repaired(text, set()) == whole


@pytest.mark.parametrize(
    ("line", "kind"),
    [("Page 12", "number"), ("— 9 —", "number"), ("xxxv", "number"), ("3 / 14", "number"), ("[7]", "number"), ("ACME 5/2023", "head"), ("ACME 5/2023   - 7 -", "both"), ("The pump was replaced.", "text"), ("12   ACME REPORT", "both")],
)
def test_edges_of_pages(line, kind):
    assert scan_repair.edge_kind(line)[0] == kind


def test_pages(spark):
    a = "ACME REPORT\n\nthe pump was replaced before the holi-\nday by tbe night shift and that\nopen-\nended work.\n\nPage 1"
    b = "Acme report   - 2 -\nthat line was open.\n"
    rows = [(1, 10, a, "x"), (2, 10, b, "x"), (2, 10, b, "x"), (3, 11, "Acme report\n\nthe line", "x"), (4, 10, None, "x"), (5, 10, "", "x"), (6, None, "the pump was", "x"), (7, 12, "the pump " * 30_000, "x")]
    df = spark.createDataFrame(rows, "id int, asset int, body string, key string")
    marks = scan_repair.scan_marks(df, "id", "asset", "body", COUNTS)
    got = {(r.key, r.defect) for r in scan_repair.page_defects(marks).collect()}
    assert got == {(1, "hyphen_break"), (1, "misread"), (1, "running_header"), (1, "page_number"), (2, "running_header"), (2, "page_number")}
    texts = {r.key: r.text for r in scan_repair.repaired_pages(df, "id", "asset", "body", COUNTS, marks).collect()}
    assert texts[1] == "the pump was replaced before the holiday by the night shift and that open-ended work."
    assert texts[2] == "that line was open." and texts[5] == "" and 4 not in texts
    empty = df.limit(0)
    assert scan_repair.page_defects(scan_repair.scan_marks(empty, "id", "asset", "body", {})).count() == 0
    assert scan_repair.lexicon(empty, "body") == {}


def test_lexicon_leaves_cut_words_out(spark):
    df = spark.createDataFrame([("a trans-\nlate well-kept",)] * 6, "t string")
    assert scan_repair.lexicon(df, "t") == {"a": 6, "well-kept": 6}


def test_lexicon_has_all_words(spark, monkeypatch):
    text = "the the the pump was translate bücherwurm مضخة"
    df = spark.createDataFrame([(text,)] * 6 + [("once",)], "t string")
    whole = scan_repair.lexicon(df, "t")
    monkeypatch.setattr(scan_repair, "LEXICON_SIZE", 2)
    counts = scan_repair.lexicon(df, "t")
    assert len(counts) == 2 and {w: counts.get(w) for w in whole} == whole and "once" not in counts
    few, every = scan_repair.Decoder(counts), scan_repair.Decoder(whole)
    for token in ("trans1ate", "vvas", "tbe", "pump", "bücherwunn", "xyz"):
        assert few.corrected(token) == every.corrected(token)
    pages = spark.createDataFrame([(1, 1, "the trans1ate pump"), (2, 1, "the pump was"), (3, 1, "was trans-\nlate")], "id int, asset int, body string")
    marks = scan_repair.scan_marks(pages, "id", "asset", "body", counts)
    assert {(r.key, r.defect) for r in scan_repair.page_defects(marks).where("defect <> 'running_header'").collect()} == {(1, "misread"), (3, "hyphen_break")}


def test_paragraph_breaks():
    lines = ["First sentence goes on and", "on until here.", "", "Second one starts here and is", "long too."]
    assert scan_repair.paragraph_breaks(lines) == {0, 3}
    assert scan_repair.paragraph_breaks([]) == set()


# spam

PROSE = "The night shift replaced the old pump before the holiday, and nobody at the front desk had noticed it. When the form arrives, check it and send the copy to the records office."


@pytest.mark.parametrize(
    "text",
    [
        "cheap pump valve buy cheap pump valve online cheap pump valve review cheap pump valve sale " * 5,
        "\n".join(f"pump{i} - http://shop.example/p/{i}" for i in range(12)),
        " ".join(f"[name {i}](http://shop.example/{i})" for i in range(12)),
        ", ".join(f"#tag{i}" for i in range(40)),
        "\n".join(f"Pump ACME-{i}11 cheap {i}9,90 EUR" for i in range(12)),
        "oferta bomba a Uno\noferta bomba a Dos\noferta bomba a Tres\noferta bomba a Cuatro\noferta bomba a Cinco\noferta bomba a Seis",
        PROSE.split(".")[0] + ".\n" + " | ".join(f"word{i}" for i in range(90)),
    ],
)
def test_spam(text):
    assert 1 - spam_pages.page_shares(text)[0] >= spam_pages.FLAG_SHARE


@pytest.mark.parametrize(
    "text",
    [
        PROSE, PROSE + "\n- Home\n- Docs\n- Blog", "\n".join(f"- https://shop.example/{i}: {PROSE}" for i in range(4)), "#12345\nA / b\n2030-01-01\n\n" + PROSE,
        "\n".join(f"[10:{i}] acme: {PROSE}" for i in range(10, 15)), " ".join(f"The {w} from Acme must stay with Acme until Acme has signed it." for w in ("pump", "valve", "form", "plan")), "Short note.",
    ],
)
def test_no_spam(text):
    assert 1 - spam_pages.page_shares(text)[0] < spam_pages.FLAG_SHARE


def test_spam_edges(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, " \n", "x"), (4, "!!! ---", "x"), (5, PROSE * 3000, "x"), (6, "#pump #valve #form #plan #tray #desk #seal #belt #weir", "x"), (6, "#pump #valve #form #plan #tray #desk #seal #belt #weir", "x"), (7, "x" * 500_000, "x")]
    df = spark.createDataFrame(rows, "id int, body string, key string")
    shares = {r.key: r for r in spam_pages.spam_shares(df, "id", "body").collect()}
    assert set(shares) == {2, 3, 4, 5, 6, 7}
    assert shares[2].prose == shares[2].menu == 0 and shares[5].prose > 0.99
    assert 6 in [r.key for r in spam_pages.spam_pages(df, "id", "body").collect()]
    assert spam_pages.spam_pages(df, "id", "body").where("key = 6").count() == 1
    assert spam_pages.spam_pages(df.limit(0), "id", "body").count() == 0


@pytest.mark.parametrize("text", ["http://a.example/x http://b.example/y http://c.example/z", "#pump #valve #form", "see http://a.example/1 - pour http://a.example/2 - avec http://a.example/3 - the rest"])
def test_short_lists_are_labelled_too(text):
    assert spam_pages.page_shares(text)[0] < 0.5


def test_pages_of_a_batch_do_not_touch():
    model = spam_pages.SpamModel.load()
    texts = [PROSE, "", "#a #b #c #d #e #f", "\n".join(f"pump {i} new" for i in range(300)), PROSE + "\n" + PROSE, "...", "x"]
    together = spam_pages.shares_of(texts, model, spam_pages.Tokens(model.words))
    assert np.allclose(together, [spam_pages.page_shares(t, model) for t in texts])


def test_viterbi_is_the_best_of_all_paths():
    import itertools

    rng = np.random.default_rng(3)
    model = spam_pages.SpamModel(*spam_training.first_model(), ())
    rows = rng.random((5, len(spam_pages.TRAITS))).round()
    rows[1, spam_pages.FUNCTION_TRAITS] = np.nan
    emit = model.emissions(rows)
    score = lambda path: model.start[path[0]] + sum(emit[i, s] for i, s in enumerate(path)) + sum(model.move[a, b] for a, b in zip(path, path[1:]))
    best = max(itertools.product(range(4), repeat=5), key=score)
    assert tuple(model.viterbi(rows, np.array([5]))) == best


def test_fitting_raises_the_likelihood_and_keeps_the_states():
    import duckdb

    texts = [r[0] for r in duckdb.sql(f"SELECT text FROM '{DATA}/documents.parquet' WHERE text IS NOT NULL").fetchall()]
    samples = duckdb.sql(f"SELECT lang, text FROM '{DATA}/lang_samples.parquet'").fetchall()
    words = spam_training.function_words(samples)
    assert {"the", "und", "le", "el"} <= words and len(words) < 400
    rows, lengths = spam_training.observed(texts, words)
    first = spam_training.first_model()
    fitted = spam_training.fit(rows, lengths, rounds=8)
    grown = [spam_training.expected(spam_pages.SpamModel(*m, words), rows, lengths)[0] for m in (first, fitted)]
    assert grown[1] > grown[0]
    end, link = spam_pages.TRAITS.index("sentence_end"), spam_pages.TRAITS.index("link")
    assert fitted[2][:, end].argmax() == 0 and fitted[2][:, link].argmax() == 1
