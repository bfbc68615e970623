"""Files to files with a fake decoder, the reproducible dialect C page, image-only first pages, and the plan's size."""

from __future__ import annotations

import json
import re
from datetime import datetime

import pytest
from ledgerloom import queries as own
from ledgerloom.operators import facts, layout, rows
from ledgerloom.plans import batch, process
from ledgerloom.sources import files, profiles
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
WORDS = "doc_id string, page_no int, word_no int, x0 double, y0 double, x1 double, y1 double, text string"
PROFILE = {
    "profile_id": "p", "display_name": "P", "profile_version": 3, "institution": "I", "document_type": "s", "parser": "td_visa_credit_card", "input_folder": "in", "output_folder": "out", "file_pattern": "*.pdf",
    "required_headers": ["Transaction date", "Posting date", "Activity description", "Amount($)"], "excluded_page_phrases": ["never", "seen"],
}
# The coordinates, dates and amounts of the published dialect C page (x0, y0, x1, y1, text); names are invented.
PAGE = [
    (49.13, 176.13, 92.39, 184.12, "TRANSACTION"), (97.48, 176.13, 123.20, 184.12, "POSTING"), (362.01, 178.35, 392.44, 188.89, "Previous"), (395.67, 178.35, 423.53, 188.89, "Balance"),
    (49.28, 183.10, 64.89, 191.09, "DATE"), (97.48, 183.10, 113.09, 191.09, "DATE"), (140.40, 183.10, 167.97, 191.09, "ACTIVITY"), (170.44, 183.10, 210.12, 191.09, "DESCRIPTION"), (309.76, 182.86, 345.12, 190.85, "AMOUNT($)"),
    (140.71, 193.09, 180.58, 203.69, "PREVIOUS"), (183.47, 193.09, 231.67, 203.69, "STATEMENT"), (234.47, 193.09, 272.51, 203.69, "BALANCE"), (301.99, 192.74, 345.71, 203.48, "$12,849.30"),
    (47.59, 212.41, 60.83, 222.28, "SEP"), (63.26, 212.41, 66.96, 222.28, "3"), (95.53, 212.41, 114.81, 222.28, "SEP4"), (140.85, 213.25, 176.96, 222.05, "BRIMVALE"), (178.95, 213.25, 216.10, 222.05, "FfNANCIAL"),
    (218.46, 213.25, 254.01, 222.05, "QUAYHILL"), (323.11, 212.54, 344.74, 222.55, "$68.00"), (361.31, 212.35, 407.99, 224.85, "RIGHT-PANEL"),
    (47.58, 231.53, 60.77, 241.54, "SEP"), (63.81, 231.53, 71.08, 241.54, "14"), (95.54, 231.53, 108.73, 241.54, "SEP"), (111.77, 231.53, 119.04, 241.54, "16"), (140.57, 232.48, 156.48, 241.28, "ZENB"),
    (158.97, 232.48, 192.03, 241.28, "MARLOWE"), (316.40, 231.29, 344.71, 241.30, "-$350.00"), (361.64, 235.52, 393.19, 246.12, "Balance"),
    (47.58, 250.53, 60.83, 260.54, "SEP"), (63.82, 250.53, 70.83, 260.54, "16"), (95.54, 250.53, 108.79, 260.54, "SEP"), (111.78, 250.64, 118.79, 260.51, "18"), (140.57, 251.48, 156.48, 260.28, "ZENB"),
    (158.97, 251.48, 192.03, 260.28, "MARLOWE"), (316.40, 250.53, 344.71, 260.54, "-$300.00"), (361.74, 250.35, 407.59, 261.71, "PAYMENT"),
    (47.58, 269.52, 60.83, 279.53, "SEP"), (63.82, 269.52, 70.83, 279.53, "19"), (95.54, 269.52, 108.79, 279.53, "SEP"), (111.77, 269.52, 119.04, 279.53, "19"), (140.37, 270.47, 165.09, 279.27, "RETAIL"),
    (167.15, 270.47, 199.97, 279.27, "INTEREST"), (319.26, 269.52, 344.49, 279.53, "$287.93"), (362.01, 275.11, 393.91, 285.65, "Payment"),
    (140.58, 288.15, 169.21, 299.86, "TOTAL"), (172.54, 288.15, 193.63, 299.86, "NEW"), (196.59, 288.15, 239.59, 299.86, "BALANCE"), (301.03, 288.66, 344.51, 299.40, "$12,555.23"),
]
TEXT = "PREVIOUS STATEMENT BALANCE $12,849.30\nTOTAL NEW BALANCE $12,555.23\n"
ROWS = [
    ("Sep 3", "Sep 4", "BRIMVALE FINANCIAL QUAYHILL", "68.00"), ("Sep 14", "Sep 16", "ZENB MARLOWE", "-350.00"), ("Sep 16", "Sep 18", "ZENB MARLOWE", "-300.00"), ("Sep 19", "Sep 19", "RETAIL INTEREST", "287.93"),
]


def _words(spark, pages):
    return spark.createDataFrame([(doc, no, k, *w) for (doc, no), ws in pages.items() for k, w in enumerate(ws)], WORDS)


def test_published_page(spark):
    words = _words(spark, {("d", 1): PAGE})
    head = layout.headers(layout.lines_of(words, 2.5), "C").first()
    assert (round(head.right_edge, 2), head.bottom) == (349.12, 191.09)
    assert [tuple(r)[3:] for r in rows.transactions(words, "C").orderBy("line_no").collect()] == ROWS
    pages = spark.createDataFrame([("d", 1, TEXT)], "doc_id string, page_no int, page_text string")
    made = process(words, pages, profiles.parse(PROFILE))
    assert made.status.first()[1:4] == ("Success", 4, [1]) and made.transactions.count() == 4
    balances = facts.printed_balances(words).first()
    assert str(balances.new_balance - balances.previous_balance) == "-294.07"


def test_image_only_first_pages(spark):
    """Page 1 without its text: C finds no table, B's totals don't match; the texts hold the published phrases."""
    pages = spark.createDataFrame([("d", 1, " \n\t"), ("d", 2, "Interest rates"), ("blank", 1, "\n  \x1c\n")], "doc_id string, page_no int, page_text string")
    made = process(_words(spark, {("d", 2): [(10.0, 10.0, 20.0, 18.0, "Interest")]}), pages, profiles.parse(PROFILE))
    errors = {r.doc_id: r.error for r in made.status.collect()}
    assert "transaction page may be image-only" in errors["d"] and errors["blank"].startswith("No readable text")
    b = own.synthetic_profile("B")
    words, texts = own._words(spark, SF, "B"), own._pages(spark, SF, "B")
    good = [r.doc_id for r in process(words, texts, b).status.filter("status = 'Success' and size(source_pages) > 1").collect()][:3]
    cut = words.filter("page_no > 1"), texts.withColumn("page_text", F.when(F.col("page_no") == 1, "").otherwise(F.col("page_text")))
    found = process(*(t.filter(F.col("doc_id").isin(good)) for t in cut), b).status.collect()
    assert len(found) == len(good) > 0 and all("totals do not match" in r.error for r in found)


def test_headings(spark):
    """Of two headings the first counts, but a smaller window over both goes before it; anchors out of order end no search; ties in x are in order."""
    y = 60.0
    second = [(a + 5, b + y, c + 5, d + y, t) for a, b, c, d, t in PAGE[:9]]
    between = [(140.0, 200.0, 160.0, 208.0, "text")]
    swapped = [(400 - c, b - 60, 400 - a, d - 60, t) for a, b, c, d, t in PAGE[:9]]
    tied = [(float(x), 176.0, x + 4.0, 184.0, t) for x, t in [(50, "TRANSACTION"), (50, "POSTING"), (140, "ACTIVITY"), (140, "DESCRIPTION"), (300, "AMOUNT"), (60, "DATE")]]
    words = _words(spark, {("close", 1): PAGE[:9] + second, ("two", 1): PAGE[:9] + between + second, ("swapped", 1): swapped + PAGE[:9], ("tied", 1): tied, ("none", 1): swapped})
    got = {r.doc_id: r for r in layout.headers(layout.lines_of(words, 2.5), "C").collect()}
    assert got["close"].bottom == 244.12 and got["two"].bottom == 191.09 and got["swapped"].bottom == 191.09 and got["tied"].cuts == [50.0, 50.0, 140.0, 300.0] and "none" not in got


def test_balance_forward_after_a_row(spark):
    """What continues below a balance forward joins the row before it; before any row it is ignored."""
    head = [(float(x), 68.0, float(x + 20), 76.0, t) for x, t in [(50, "Trans."), (100, "Eff."), (150, "Transaction"), (300, "Funds"), (332, "out"), (380, "Funds"), (412, "in"), (460, "Balance")]]
    head += [(50.0, 76.0, 70.0, 84.0, "date"), (100.0, 76.0, 118.0, 84.0, "date")]

    def line(y, *ws):
        return [(float(x), y - 4, float(x + 12), y + 4, t) for x, t in ws]

    forward = [(50, "Jan"), (66, "1"), (100, "Jan"), (116, "1"), (152, "Balance"), (180, "Forward"), (462, "5.00")]
    row = [(50, "Jan"), (66, "2"), (100, "Jan"), (116, "2"), (152, "SHOP"), (305, "1.00"), (462, "4.00")]
    ws = head + line(100.0, *forward) + line(112.0, (152, "IGNORED")) + line(130.0, *row) + line(142.0, *forward) + line(154.0, (152, "JOINED"))
    got = rows.transactions(_words(spark, {("d", 1): ws}), "B").collect()
    assert [(r.transaction, r.funds_out, r.funds_in) for r in got] == [("SHOP JOINED", "1.00", "")]


def test_plan_reads_words_once(spark, tmp_path):
    """From Parquet, the accepted transactions take two scans of words at most and ten exchanges."""
    own._words(spark, SF, "C").write.parquet(str(tmp_path / "words"))
    own._pages(spark, SF, "C").write.parquet(str(tmp_path / "pages"))
    made = process(spark.read.parquet(str(tmp_path / "words")), spark.read.parquet(str(tmp_path / "pages")), own.synthetic_profile("C"))
    for df in (made.transactions, made.status):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert len(re.findall(r"FileScan parquet .*/words", plan)) <= 2 and len(re.findall(r"(?m)^[^\n]*\bExchange (?:hash|range|single)", plan)) <= 10, plan
        assert "Python" not in plan and "Arrow" not in plan


def _read(found):
    """A file is JSON: a list of [text, words, images], or an error to raise."""

    def fake(content):
        import json

        data = json.loads(content)
        if isinstance(data, str):
            raise {"runtime": RuntimeError, "value": ValueError, "key": KeyError}[data]("broken")
        return [(text, [tuple(w) for w in words], images) for text, words, images in data]

    return files.decode(found, fake)


def _put(root, name, data):
    (root / name).parent.mkdir(parents=True, exist_ok=True)
    (root / name).write_text(json.dumps(data))


def test_folder_to_files(spark, tmp_path):
    good = [[TEXT, PAGE, 2]]
    for name, data in {"b.pdf": good, "sub/b.pdf": good, "A bad.pdf": "runtime", "c.pdf": "key", "image.pdf": [[" \n", [], 1]], "empty.pdf": [], "short.pdf": [[TEXT, PAGE[:29] + PAGE[-4:], 0]], "x.txt": good}.items():
        _put(tmp_path / "in", name, data)
    profile = profiles.parse({**PROFILE, "recursive": True, "preserve_subfolders": True})
    done = batch.process_folder(spark, profile, str(tmp_path / "in"), str(tmp_path / "out"), _read, now=datetime(2024, 5, 6, 7, 8, 9))
    made = sorted(str(p.relative_to(tmp_path / "out")) for p in (tmp_path / "out").rglob("*") if p.is_file() and not p.name.startswith("."))
    assert made == ["b_transactions.csv", "batch_processing_summary_20240506_070809.csv", "sub/b_transactions.csv"]
    header = "Transaction date,Posting date,Activity description,Amount($)\n"
    assert (tmp_path / "out/sub/b_transactions.csv").read_text() == header + "".join(",".join(r) + "\n" for r in ROWS)
    lines = (tmp_path / "out/batch_processing_summary_20240506_070809.csv").read_text().splitlines()
    assert lines[0] == ",".join(batch.SUMMARY) and [x.split(",")[3] for x in lines[1:]] == ["A bad.pdf", "b.pdf", "c.pdf", "empty.pdf", "image.pdf", "short.pdf", "b.pdf"]
    status = {r.doc_id: r for r in done.status.collect()}
    assert status["A bad.pdf"].error.startswith("Could not read PDF ") and status["A bad.pdf"].error.endswith(": broken") and status["c.pdf"].error == "Unexpected error: 'broken'"
    assert status["image.pdf"].error.startswith("No readable text") and status["empty.pdf"].error.startswith("No readable text") and status["short.pdf"].error.startswith("Does not reconcile")
    assert (status["sub/b.pdf"].status, status["sub/b.pdf"].n_txn, status["sub/b.pdf"].source_pages) == ("Success", 4, [1])
    assert f'P,3,I,b.pdf,Success,4,1,file:{tmp_path}/out/sub/b_transactions.csv,' .replace("P,", "p,", 1) in lines
    stats = facts.page_stats(_read(files.find(spark, str(tmp_path / "in"), "b.pdf")), files.words_of(_read(files.find(spark, str(tmp_path / "in"), "b.pdf")))).first()
    assert (stats.images, stats.positioned_words) == (2, len(PAGE))


def test_equal_names_without_subfolders(spark, tmp_path):
    """Without subfolders the last file of a name, in path order, stays; statements are never merged."""
    _put(tmp_path / "in", "a/b.pdf", [[TEXT, PAGE, 0]])
    _put(tmp_path / "in", "z/b.pdf", [[TEXT, [(*w[:4], w[4].replace("QUAYHILL", "LAST")) for w in PAGE], 0]])
    done = batch.process_folder(spark, profiles.parse({**PROFILE, "recursive": True}), str(tmp_path / "in"), str(tmp_path / "out"), _read)
    assert [r.n_txn for r in done.status.collect()] == [4, 4] and "BRIMVALE FINANCIAL LAST" in (tmp_path / "out/b_transactions.csv").read_text()


def test_errors_before_any_file(spark, tmp_path):
    profile = profiles.parse(PROFILE)
    with pytest.raises(batch.ProcessingError, match="Input folder not found"):
        batch.process_folder(spark, profile, str(tmp_path / "no"), str(tmp_path / "out"), _read)
    (tmp_path / "in").mkdir()
    with pytest.raises(batch.ProcessingError, match=r"No PDF files matching '\*.pdf' found in"):
        batch.process_folder(spark, profile, None, None, _read, root=str(tmp_path))
    with pytest.raises(batch.ProcessingError, match="PDF file not found"):
        batch.process_pdf(spark, profile, str(tmp_path / "in/x.pdf"), None, _read)
    with pytest.raises(batch.ProcessingError, match="not both"):
        batch.select_profile(profile, "x.json")
    with pytest.raises(batch.ProcessingError, match="unsupported parser"):
        batch.select_profile(profiles.parse({**PROFILE, "parser": "x"}))
    with pytest.raises(batch.ProcessingError, match="Profile not found"):
        batch.select_profile(default_path=str(tmp_path / "none.json"))
    assert batch.select_profile(profile) is profile


def test_one_file(spark, tmp_path):
    _put(tmp_path, "in/a.b.pdf", [[TEXT, PAGE, 0]])
    _put(tmp_path, "in/bad.pdf", "value")
    found, at = batch.process_pdf(spark, profiles.parse(PROFILE), str(tmp_path / "in/a.b.pdf"), str(tmp_path / "out"), _read)
    assert [tuple(r) for r in found.collect()] == ROWS and at.endswith("/out/a.b_transactions.csv") and (tmp_path / "out/a.b_transactions.csv").is_file()
    with pytest.raises(batch.ProcessingError, match="Could not read PDF"):
        batch.process_pdf(spark, profiles.parse(PROFILE), str(tmp_path / "in/bad.pdf"), str(tmp_path / "out"), _read)
