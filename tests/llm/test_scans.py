import pytest

from quire.llm import scans


@pytest.mark.parametrize("read,meant", [("rnetbod", "method"), ("coulcl", "could"), ("northem", "northern"), ("dispiite", "dispute"), ("occiir", "occur"), ("electncity", "electricity"), ("milhon", "million"), ("tanff", "tariff"), ("0b1igations", "obligations"), ("star~t", "start"), ("!ssued", "issued"), ("st0rt", "start"), ("clehvery", "delivery")])
def test_confusions(read, meant):
    assert scans.repair_cost(read, meant) <= scans.MOST_COST and set(scans.deletes(read)) & set(scans.deletes(meant))


@pytest.mark.parametrize("a,b", [("gelzutass", "gelzutazz"), ("cost", "costs"), ("dorlovenix", "dorlpvenix"), ("market", "basket")])
def test_no_confusions(a, b):
    assert scans.repair_cost(a, b) > scans.MOST_COST


@pytest.mark.parametrize("text", ["9", "Page 9 of 12", "- 9 -", "p. 9", "F-9", "[9]", "iv", "xii", "Page l of l", "[l]", "l9", "3/12", "Seite 4", "S. 4"])
def test_page_numbers(text):
    assert scans.is_page_number(text)


@pytest.mark.parametrize("text", ["Annual Report 2019", "2022 CONSOLIDATED STATEMENTS", "See accompanying notes", "Form and Notes 2019 | 9", "", "--", "Copyright 2020 Firm Ltd"])
def test_running_lines(text):
    assert not scans.is_page_number(text)


def test_wrong_page_numbers():
    assert [t for t in ("9", "iv", "Page 2 of 3", "F-2", "p. 4", "[l]", "l9", "F-l", "Page 3 of ll", "4O") if scans.wrong_page_number(t)] == ["[l]", "l9", "F-l", "Page 3 of ll", "4O"]


FILL = ["The decrease in sales was due to the closing of night counters under the old tariff.", "It is possible that the withdrawal of certain customers would reduce our margins.", "Spare-parts sales and year-end figures of 2,019 were confirmed by the outside expert.", "There the mill of the group and other activities had no lasting effect on the balance."]


def page(blocks, page_id, document, lines, method="ocr", top=84.0, head="Annual Report 2019", foot=None):
    """Adds a page's lines to blocks, a running head and a page number below."""
    rows = [(head, 36.0)] + [(t, top + 12 * k) for k, t in enumerate(lines)] + [(foot or str(page_id), 761.0)]
    for text, y in rows:
        blocks.append((len(blocks) + 1, page_id, document, len(blocks) + 1, text, 36.0, y, 36.0 + 5 * len(text or ""), y + 9.5, method, 90.0))


@pytest.fixture(scope="module")
def tables(spark):
    blocks = []
    for k in range(1, 7):
        page(blocks, k, "clean", FILL * 2, "direct")
    page(blocks, 11, "scan", ["The closing of night cus-", "tomers and the year-", "end balance of the withdr¬", "awal had no las ting effect,", "ofthe 2,O19 figures, tbe outsidc expert", "would rEduce Gelzutazz sales and with-"], foot="Page l of 2")
    page(blocks, 12, "scan", [])
    page(blocks, 13, "scan", ["drawal of certain customers."])
    pages = [(p, "clean" if p < 10 else "scan", p, 792.0, "x") for p in (*range(1, 7), 11, 12, 13)]
    blocks += [blocks[-2], (900, 11, "scan", 900, None, 36.0, 400.0, 40.0, 409.5, "ocr", None), (901, 11, "scan", 901, " ", 36.0, 420.0, 40.0, 429.5, "ocr", None), (902, 999, "lost", 1, "tbe", 36.0, 420.0, 40.0, 429.5, "ocr", None)]
    kinds = "id bigint, page_id bigint, document_id string, block_order int, text string, x0 double, top double, x1 double, bottom double, method string, confidence double"
    return spark.createDataFrame(pages, "id bigint, document_id string, page_number int, height double, zone string"), spark.createDataFrame(blocks, kinds)


def test_defects(spark, tables):
    pages, blocks = tables
    text = {r["id"]: r["text"] for r in blocks.where("id IS NOT NULL").collect()}
    found = scans.scan_defects(pages, blocks).collect()
    assert len(found) == len({tuple(r) for r in found})
    by = {}
    for r in found:
        by.setdefault(r["defect"], set()).add(text[r["block_id"]])
    assert by["hyphen"] == {"The closing of night cus-", "end balance of the withdr¬", "would rEduce Gelzutazz sales and with-"}
    assert by["misread"] == {"awal had no las ting effect,", "ofthe 2,O19 figures, tbe outsidc expert", "would rEduce Gelzutazz sales and with-", "Page l of 2"}
    assert by["running_line"] == {"Annual Report 2019"} and by["page_number"] == {"Page l of 2", "12", "13", *map(str, range(1, 7))}


def test_paragraphs(spark, tables):
    pages, blocks = tables
    rows = {(r["page_id"], r["paragraph"]): r["text"] for r in scans.page_paragraphs(pages, blocks).collect()}
    assert rows[11, 0] == "The closing of night customers and the year-end balance of the withdrawal had no lasting effect, of the 2,019 figures, the outside expert would reduce Gelzutazz sales and with-"
    assert rows[13, 0] == "drawal of certain customers." and (12, 0) not in rows


def test_nothing(spark, tables):
    pages, blocks = tables
    assert scans.scan_defects(pages.limit(0), blocks.limit(0)).count() == 0
    assert scans.page_paragraphs(pages.limit(0), blocks.limit(0)).count() == 0
    assert scans.scan_defects(pages, blocks.limit(0)).count() == 0


def test_capital_words_that_are_no_names(spark):
    blocks = []
    for k in range(1, 16):
        page(blocks, k, "clean", ["Sales of Gelzutozz rose in March by the end of the year, and Reports followed."] * 2, "direct")
    page(blocks, 21, "scan", ["sales rose in Morch by the end", "and Gelzutazz followed", "the Rcports of the year"])
    pages = spark.createDataFrame([(p, "clean" if p < 20 else "scan", p, 792.0) for p in (*range(1, 16), 21)], "id bigint, document_id string, page_number int, height double")
    rows = spark.createDataFrame(blocks, "id bigint, page_id bigint, document_id string, block_order int, text string, x0 double, top double, x1 double, bottom double, method string, confidence double")
    text = {b[0]: b[4] for b in blocks}

    def misread(*names):
        mentions = spark.createDataFrame([(n,) for n in names], "text string") if names else None
        return {text[r["block_id"]] for r in scans.scan_defects(pages, rows, mentions).where("defect = 'misread'").collect()}

    assert misread("Gelzutozz\nHoldings") == {"sales rose in Morch by the end", "the Rcports of the year"}
    assert misread("Gelzutozz Ltd", "Jon Morch") == {"the Rcports of the year"}
    assert misread() == set()
    got = {r["text"] for r in scans.page_paragraphs(pages, rows, spark.createDataFrame([("Gelzutozz",)], "text string")).where("page_id = 21").collect()}
    assert "sales rose in March by the end" in " ".join(got) and "Gelzutazz" in " ".join(got) and "the Reports of" in " ".join(got)


def test_words_cut_at_the_end_of_a_page(spark, tables, tmp_path):
    from quire.llm import queries

    pages, blocks = tables
    more = []
    page(more, 14, "scan", ["They were confirmed by the out-"])
    page(more, 15, "scan", ["side expert of the group and year-"])
    page(more, 16, "scan", ["end figures of the group and sales-"])
    page(more, 17, "scan", ["and other parts of the balance-"])
    page(more, 18, "other", ["sheet of the group."])
    more = [(1000 + b[0], *b[1:]) for b in more]
    pages = pages.unionAll(spark.createDataFrame([(p, "scan" if p < 18 else "other", p, 792.0, "x") for p in range(14, 19)], pages.schema))
    blocks = blocks.unionAll(spark.createDataFrame(more, blocks.schema))
    rows = {r["page_id"]: r["text"] for r in scans.page_paragraphs(pages, blocks, over_pages=True).where("page_id > 10").collect()}
    assert rows[11].endswith("Gelzutazz sales and withdrawal") and rows[13] == "of certain customers."
    assert [rows[p] for p in range(14, 19)] == ["They were confirmed by the outside", "expert of the group and year-end", "figures of the group and sales-", "and other parts of the balance-", "sheet of the group."]
    for name, df in (("pages", pages), ("blocks", blocks), ("entity_mentions", spark.createDataFrame([("Gelzutazz",)], "text string"))):
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    assert {r["page_id"]: r["text"] for r in queries.p1_paragraphs(spark, str(tmp_path)).where("page_id > 10").collect()} == rows


SOUND = ["the company reported revenue of the logistics segment", "expenses for transport and storage were lower", "customers of the company paid for transport in advance", "revenue of the northern branch grew in autumn", "the managers expect lower expenses for storage", "our warehouse in the harbour was closed in autumn"]
SLIPS = {"comany": "company", "revnue": "revenue", "logstics": "logistics", "segmxnt": "segment", "expennses": "expenses", "transprt": "transport", "storags": "storage", "cusomers": "customers", "advancee": "advance", "northrn": "northern", "brannch": "branch", "manaqers": "managers", "warehousse": "warehouse", "harbur": "harbour", "autuxn": "autumn", "cloxed": "closed", "repoorted": "reported", "lowwer": "lower", "expekt": "expect", "grewx": "grew"}


@pytest.fixture(scope="module")
def slipped(spark):
    """Pages of sound lines, and a scan with one plain slip a line."""
    blocks, number = [], 0
    for k in range(1, 9):
        page(blocks, k, "clean", SOUND * 2, "direct")
    lines = [" ".join(wrong if w == right else w for w in line.split()) for wrong, right in SLIPS.items() for line in [next(x for x in SOUND if right in x.split())]]
    page(blocks, 20, "scan", lines)
    pages = spark.createDataFrame([(p, "clean" if p < 20 else "scan", p, 792.0) for p in (*range(1, 9), 20)], "id bigint, document_id string, page_number int, height double")
    return pages, spark.createDataFrame(blocks, "id bigint, page_id bigint, document_id string, block_order int, text string, x0 double, top double, x1 double, bottom double, method string, confidence double"), blocks


def test_plain_slips(slipped, monkeypatch):
    pages, rows, blocks = slipped
    slips = {b[0] for b in blocks if b[1] == 20 and set(b[4].split()) & SLIPS.keys()}
    found = lambda: {r["block_id"] for r in scans.scan_defects(pages, rows).where("defect = 'misread'").collect()}
    assert len(slips) == 20 and len(found() & slips) >= 18
    monkeypatch.setattr(scans, "SPEAKING", 2.0)  # without the words beside them, none is accepted
    assert len(found() & slips) <= 5


def test_deletions_find_the_slips(slipped, monkeypatch):
    """Without the keys of letters left out, the index does not bring slips and words together."""
    assert not any(set(scans.shapes(a)) & set(scans.shapes(b)) for a, b in SLIPS.items() if len(a) != len(b) and a != "comany" and scans.repair_cost(a, b) > scans.MOST_COST)
    assert all(set(scans.deletes(a)) & set(scans.deletes(b)) for a, b in SLIPS.items())


def test_neighbours_choose_the_repair(spark):
    """`nat` may stand for `hat` or `bat`; what stands beside it tells which."""
    blocks = []
    for k in range(1, 9):
        page(blocks, k, "clean", ["she wore a warm hat every winter", "the old bat flew by night again"] * 3, "direct")
    page(blocks, 20, "scan", ["she wore a warm oat every winter", "the old 6at flew by night again", "the warm nat every winter", "the old nat flew by night"])
    pages = spark.createDataFrame([(p, "clean" if p < 20 else "scan", p, 792.0) for p in (*range(1, 9), 20)], "id bigint, document_id string, page_number int, height double")
    rows = spark.createDataFrame(blocks, "id bigint, page_id bigint, document_id string, block_order int, text string, x0 double, top double, x1 double, bottom double, method string, confidence double")
    text = " ".join(r["text"] for r in scans.page_paragraphs(pages, rows).where("page_id = 20").collect())
    assert "the warm hat every winter" in text and "the old bat flew by night" in text


def test_long_words(spark):
    long = "antidisestablishmentarianismandcounterreformation"
    assert scans.repair_cost(long.replace("m", "rn", 1), long) <= scans.MOST_COST and set(scans.deletes(long)) & set(scans.deletes(long.replace("m", "rn", 1)))
    assert scans.repair_cost("x" * 30_000, "x" * 29_999 + "y") == 1.0
