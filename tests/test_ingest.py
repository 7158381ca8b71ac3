"""Whole runs over a small archive: scan, normal forms, work items, links, facts, changes, views, drops."""

from __future__ import annotations

import json

import pytest

from factloom.operators import views
from factloom.plans import ingest
from factloom.sources.leases import Busy, Lease
from factloom.streaming import drops
from tests import archive


@pytest.fixture(scope="module")
def runs(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("archive")
    root, store = archive.write(folder), str(folder / "store")
    texts = spark.createDataFrame(archive.TEXTS, "path string, text string, page_count int")
    return ingest.replay(spark, root, store, "2025-01-02T00:00:00Z", ["day-02", "day-01"], texts=texts)


def rows(frame, *columns):
    return sorted(tuple(r) for r in frame.select(*columns).collect())


def test_scan_and_registry(runs):
    got = {r.path: (r.kind, r.status, r.source_id, r.duplicate_of) for r in runs[0]["registry"].collect()}
    assert got["data/other/readme.txt"][:2] == ("unknown", "ignored")
    assert got["data/stammdaten/stammdaten.json"][:3] == ("master_data", "normalized", "MASTER-STAMMDATEN")
    assert got["data/bank/bank_index.csv"][2] == "INDEX-BASE-BANK-INDEX" and got["data/bank/camt.xml"][2] == "BANK-BASE-CAMT"
    assert got["data/rechnungen/2024-03/20240310_DL-007_INV-DUP-00009.pdf"][1:] == ("duplicate", "INV-DUP-00009", "INV-00009")
    assert not any("incremental" in p for p in got)
    later = {r.path: r.status for r in runs[1]["registry"].collect()}
    assert later["data/incremental/day-01/incremental_manifest.json"] == "normalized" and not any("day-02" in p for p in later)


def test_normal_forms(runs):
    text = {r.source_id: r for r in runs[0]["documents"].collect()}
    assert text["EMAIL-00001"].text.splitlines()[0] == "# Email EMAIL-00001" and "Frist bis zum Montag" in text["EMAIL-00001"].text
    assert text["EMAIL-00002"].meta.headers["references"] == "<a0@mail> <a1@mail>"
    bill = text["INV-00009"].meta
    assert (bill.invoice_number, bill.customer_number, bill.invoice_date, bill.net_amount, bill.vat_amount, bill.gross_amount) == ("RE-9", "K1", "10.03.2024", "1000.00", "190.00", "1190.00")
    letter = text["LTR-00003"].meta
    assert letter.letter_type == "etv_protokoll" and letter.decisions == ["TOP 1: Dach", "TOP 2: Wirtschaftsplan 100,00 EUR"] and letter.subject == "Protokoll der Eigentuemerversammlung"
    records = [r for r in runs[0]["records"].collect() if r.file_name == "kontoauszug.csv"]
    assert len(records) == 1 and records[0].row["Verwendungszweck"] == 'Rg "9"\nTeil'


def test_work_items(runs):
    items = {r.work_item_id: r for r in runs[0]["queue"].collect()}
    assert "WI-EMAIL_THREAD-2024-03-WASSERSCHADEN-IN-WE-16-TOM-TOM-EXAMPLE" in items
    assert {"WI-MASTER_DATA_BUNDLE-BASE-MASTER-DATA-AND-INDEXES", "WI-BANK_GROUP-BASE-BANK-LEDGER", "WI-INVOICE_GROUP-DL-007-INV-00009", "WI-LETTER_GROUP-2024-05-ETV_PROTOKOLL"} <= set(items)
    thread = items["WI-EMAIL_THREAD-2024-03-WASSERSCHADEN-IN-WE-16-TOM-TOM-EXAMPLE"].glimpse
    assert thread.summary == "2 email messages grouped as a thread about Re: Wasserschaden in WE 16." and thread.metrics == {"messageCount": 2} and thread.dateRange == ["2024-03-01", "2024-03-02"]
    assert thread.preview["participants"] == ["Tom <tom@example.org>", "verwaltung@example.org"]
    day = [r for r in runs[1]["queue"].collect() if r.kind == "incremental_day"]
    assert [r.work_item_id for r in day] == ["WI-INCREMENTAL_DAY-DAY-01"] and day[0].glimpse.sourceCount == 2


def test_links(runs):
    found = {(r.entity_id, r.match_type) for r in runs[0]["candidates"].where("source_id = 'EMAIL-00001'").collect()}
    assert {("LIE-001", "property_scope"), ("EMAIL-00001", "declared_id"), ("MIE-001", "declared_id"), ("MIE-001", "email"), ("EH-016", "alias"), ("EH-016", "relationship"), ("EIG-001", "relationship"), ("HAUS-12", "relationship")} <= found
    decisions = dict(rows(runs[0]["links"].where("target_type = 'source'"), "target_id", "decision"))
    assert decisions["EMAIL-00001"] == "linked" and decisions["EMAIL-00003"] == "linked"


def test_facts(runs):
    facts = {(r.kind, r.subject_id): r for r in runs[0]["facts"].collect()}
    paid = facts["payment", "TX-00001"]
    assert paid.merged == 2 and paid.source_count == 2 and paid.decision == "keep"
    assert facts["payment", "TX-00002"].decision == "needs_review" and facts["invoice", "INV-FAKE-2"].decision == "needs_review"
    assert facts["relationship", "unit_in_building:EH-016:HAUS-12"].fact_id == "FACT-0D578A89EDB919BB"
    assert facts["relationship", "owner_owned_unit:EIG-001:EH-016"].to_entity_id == "EH-016"
    assert facts["relationship", "tenant_occupied_unit:MIE-001:EH-016:2024-02-01"].valid_to == "2024-12-31"
    assert json.loads(facts["property_profile", "LIE-001"].canonical_entity)["entity_type"] == "property"
    assert facts["communication", "WI-EMAIL_THREAD-2024-03-WASSERSCHADEN-IN-WE-16-TOM-TOM-EXAMPLE"].source_count == 2


def test_triage(runs):
    got = {r.work_item_id: (r.decision, r.categories) for r in runs[0]["decisions"].collect()}
    assert got["WI-EMAIL_THREAD-2024-03-WASSERSCHADEN-IN-WE-16-TOM-TOM-EXAMPLE"][0] == "needs_review"
    assert got["WI-EMAIL_THREAD-2024-03-NEWSLETTER-NEWS-EXAMPLE"] == ("ignore", ["governance", "noise"])
    assert got["WI-BANK_GROUP-BASE-BANK-LEDGER"] == ("metadata_only", [])


def test_second_run_reuses_and_tells_changes(runs):
    first, second, _ = runs
    assert second.counts["reused_normalized"] == first.counts["normalized"]
    assert first.counts["extraction_reused"] == 0 and second.counts["extraction_reused"] == first.counts["extraction_work_items"] and second.counts["extraction_extracted"] == 1
    assert (second.counts["facts_added"], second.counts["facts_removed"]) == (2, 0) and second.counts["facts_previous"] == first.counts["facts_following"]
    touched = {r.view for r in second["affected_views"].collect()}
    assert {"contexts/LIE-001/Context.md#invoices", "contexts/LIE-001/view-manifest.json", "contexts/LIE-001/entities/INV-00010.md", "contexts/LIE-001/entities/DL-007.md"} <= touched
    assert {r.section_id for r in second["patch_log"].collect()} >= {"invoices", "provenance"} and "owners" not in {r.section_id for r in second["patch_log"].collect()}


DELTA_TABLES = {
    "documents": ["source_id", "status", "artifact", "text", "normalized_sha256"], "records": ["source_id", "field", "line_no", "path"], "alias_hits": ["source_id", "folded"], "candidates": ["source_id", "entity_id", "match_type", "inherited_from", "evidence"],
    "deterministic": ["observation_id", "work_item_id", "source_id", "statement", "fact_kind", "subject_id"], "facts": None, "fact_sources": None, "fact_entities": None, "links": None,
}


def test_replayed_days_equal_one_whole_run(runs, spark, tmp_path):
    """Two days upon the base, against base and days at once; and what a day wrote is in proportion to it."""
    base, second, third = runs
    root = archive.write(tmp_path)
    whole = ingest.ingest(spark, root, str(tmp_path / "store"), "2025-01-02T00:00:00Z", "all-incremental", texts=spark.createDataFrame(archive.TEXTS, "path string, text string, page_count int"))
    assert third.counts["coverage_result"] == whole.counts["coverage_result"] == "PASS"
    for name, columns in DELTA_TABLES.items():
        frames = [r[name] if columns is None else r[name].select(*columns) for r in (third, whole)]
        a, b = (sorted(repr(tuple(x)) for x in f.collect()) for f in frames)
        assert a == b, name
    for name in ("documents", "deterministic", "facts", "fact_sources", "fact_evidence"):
        assert 0 < second.rows[name] <= 0.25 * base.rows[name], name
    assert 0 < second.counts["searched_bytes_new"] < 0.25 * base.counts["searched_bytes_new"]
    # The day's invoice is an entity with new aliases, so older texts are searched again, but for these only.
    assert 0 < second.rows["new_terms"] < base.rows["terms"] and second.counts["searched_bytes_old"] > second.counts["searched_bytes_new"]


def test_progress_is_told_as_it_happens(runs, spark):
    told = spark.read.schema(ingest.EVENTS).json(f"{runs[1].folder}/events").orderBy("place").collect()
    assert [(r.stage, r.level, r.message) for r in told] == runs[1].events and told[0].stage == "scan" and told[0].rows["scanned"] > 10
    assert {r.status for r in runs[1]["work_item_states"].collect()} <= {"processed", "ignored"}


def test_document_and_pages(runs, spark):
    text = runs[1]["document"].first().text
    found = views.sections_of(spark.createDataFrame([("x", text)], "k string, text string"), "k", "text").collect()
    assert len(found) == 14 and all(views.text_hash(r.content) == r.marked_hash for r in found)
    assert "Generated: 2025-01-02T00:00:00Z" in text and "| INV-FAKE-2 | 2024-04-01 | DL-FAKE-7 |" in text
    assert "| LTR-00003 | 2024-05-02 | etv_protokoll | TOP 1: Dach; TOP 2: Wirtschaftsplan 100,00 EUR | [LTR-00003] |" in text
    assert "- Approx. negative outflow total: -12.50" in text and "| TX-00002 | 2024-03-06 | CREDIT | 700.00 | Tom Rau | Miete |" in text
    page = {r.entity_id: r.text for r in runs[1]["entity_documents"].collect()}
    assert "| EIG-001 | owner | Ana Beck |" in page["EH-016"] and "| MIE-001 | tenant | Tom Rau |" in page["EH-016"] and "EMAIL-00001" not in page
    assert runs[1]["view_manifest"].where("view = 'contexts/LIE-001/entities/DL-007.md' AND kind = 'fact'").count() >= 2


def test_coverage(runs):
    row = runs[1]["coverage"].first()
    assert row.result == "PASS" and row.pending == 0 and row.eligible == row.assigned
    lines = [r.line for r in runs[1]["coverage_report"].orderBy("place").collect()]
    assert lines[0] == "# Coverage Report" and "- Source assignment status: PASS" in lines and lines[-1] == "- All work items have terminal outcomes."


def test_a_run_of_another_driver_is_waited_out(spark, tmp_path):
    with Lease(str(tmp_path / "s")), pytest.raises(Busy):
        ingest.ingest(spark, archive.write(tmp_path), str(tmp_path / "s"), "now")


def test_only_one_run_at_a_time(spark, tmp_path):
    ingest.ONE_AT_A_TIME.acquire()
    try:
        with pytest.raises(RuntimeError):
            ingest.ingest(spark, str(tmp_path), str(tmp_path / "s"), "now")
    finally:
        ingest.ONE_AT_A_TIME.release()


def test_modes(spark, tmp_path):
    root = archive.write(tmp_path)
    assert ingest.through_day(spark, root, None) == (None, True)
    assert ingest.through_day(spark, root, "all-incremental") == ("day-99", False)
    assert ingest.through_day(spark, root, "latest-incremental") == ("day-02", False)


def test_replay_and_stream_apply_days_in_order(spark, tmp_path):
    root, seen = archive.write(tmp_path), []
    query = drops.apply_drops(spark, root, str(tmp_path / "s"), "now", lambda *a, **_: seen.append(a[4]))
    query.awaitTermination(120)
    assert seen == ["day-01", "day-02"]
