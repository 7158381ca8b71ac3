"""DuckDB SQL with the same results as the catalog's queries, over the same tables."""

from __future__ import annotations

DAY = "strftime({}, '%Y-%m-%d')".format
STAMP = "upper(substr(sha256({}), 1, 16))".format


def made_id(prefix: str, *parts: str) -> str:
    """An id of a JSON text, whose parts are SQL texts."""
    return f"'{prefix}-' || " + STAMP(" || ".join(parts))


def quoted(value: str) -> str:
    return f"to_json({value})"


def obs_id(prefix: str, **fields: str) -> str:
    body = " || ',' || ".join(f"'\"{name}\":' || to_json({value})" for name, value in fields.items())
    return f"'{prefix}-' || " + STAMP("'{' || " + body + " || '}'")


INDEX = """index_ AS (
 SELECT 'LIE-' || r_regionkey AS entity_id, 'property' AS entity_type, r_name AS name, COALESCE((SELECT list('HAUS-' || n_nationkey ORDER BY 'HAUS-' || n_nationkey) FROM nation WHERE n_regionkey = r_regionkey), []) AS related FROM region
 UNION ALL SELECT 'HAUS-' || n_nationkey, 'building', n_name, ['LIE-' || n_regionkey] FROM nation
 UNION ALL SELECT 'MIE-' || c_custkey, 'tenant', c_name, ['HAUS-' || c_nationkey] FROM customer
 UNION ALL SELECT 'DL-' || s_suppkey, 'contractor', s_name, ['HAUS-' || s_nationkey] FROM supplier)"""
EDGES = """edges AS (SELECT DISTINCT i.entity_id AS from_id, x.to_id FROM index_ i, unnest(i.related) AS x(to_id) WHERE x.to_id IN (SELECT entity_id FROM index_))"""
CLOSURE = f"""{INDEX}, {EDGES},
d AS (SELECT DISTINCT CAST(o_orderkey AS VARCHAR) AS source_id, 'MIE-' || o_custkey AS entity_id FROM orders),
-- What an order reaches depends on its customer only.
start AS (SELECT DISTINCT entity_id FROM d),
reach AS (SELECT entity_id AS s, entity_id FROM start UNION SELECT r.s, e.to_id FROM reach r JOIN edges e ON r.entity_id = e.from_id),
walked AS (SELECT DISTINCT r.s, e.to_id AS entity_id, e.from_id AS inherited_from FROM reach r JOIN edges e ON r.entity_id = e.from_id),
closure AS (SELECT source_id, w.entity_id, inherited_from FROM d JOIN walked w ON d.entity_id = w.s)"""
HASHED = "h AS (SELECT doc_id, lang, source, sha256(text) AS raw_sha256 FROM documents)"
MARKED = f"{HASHED}, m AS (SELECT *, CASE WHEN min(doc_id) OVER (PARTITION BY raw_sha256) <> doc_id THEN min(doc_id) OVER (PARTITION BY raw_sha256) END AS duplicate_of FROM h)"
REGISTRY = f"{HASHED}, p AS (SELECT raw_sha256, min(doc_id) AS first FROM h WHERE source <> 'src1' OR source IS NULL GROUP BY 1), r AS (SELECT h.doc_id, CASE WHEN source = 'src1' THEN 'ignored' WHEN first <> h.doc_id THEN 'duplicate' ELSE 'discovered' END AS status FROM h LEFT JOIN p USING (raw_sha256))"
VERSIONS = """base AS (SELECT o_orderkey, o_orderdate, sha256(o_orderkey || '|' || o_orderstatus) AS raw_sha256 FROM orders),
p AS (SELECT o_orderkey, raw_sha256 FROM base WHERE o_orderdate < TIMESTAMP '1997-01-01'),
c AS (SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN sha256(raw_sha256 || 'x') ELSE raw_sha256 END AS raw_sha256 FROM base WHERE o_orderdate >= TIMESTAMP '1994-01-01')"""
PAYMENTS = f"""pay AS (SELECT 'TX-' || l_orderkey AS payment_id, CASE WHEN l_returnflag = 'R' THEN 'DEBIT' ELSE 'CREDIT' END AS type, CAST(l_extendedprice AS DECIMAL(18,2)) AS amount,
 {DAY('l_shipdate')} AS date, 'DL-' || l_suppkey AS party, 'INV-' || l_orderkey AS reference, CASE WHEN l_linestatus = 'O' THEN 'open' ELSE '' END AS error_types,
 l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS source_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
signed AS (SELECT *, CASE WHEN amount >= 0 AND type = 'DEBIT' THEN -amount ELSE amount END AS signed FROM pay)"""
PAY_OBS = f"""{PAYMENTS}, po0 AS (SELECT *, 'Payment ' || payment_id || ' is ' || type || ' ' || CAST(amount AS VARCHAR) || ' on ' || date || ' with ' || party || ' for ' || reference || '.' AS statement,
 '{{"transactionId":"' || payment_id || '","date":"' || date || '","eventDate":"' || date || '","type":"' || type || '","amount":"' || amount || '","counterparty":"' || party || '","reference":"' || reference || '","primaryEntityId":"' || payment_id
 || '","entities":["' || payment_id || '","LIE-001"],"row":{{"id":"' || payment_id || '","datum":"' || date || '","typ":"' || type || '","betrag":"' || amount || '","gegen_name":"' || party || '","verwendungszweck":"' || reference || '","error_types":"' || error_types || '"}}}}' AS attributes FROM pay),
po AS (SELECT {made_id("OBS", """'{"inputHash":"h0","kind":"payment","sourceIds":["' || source_id || '"],"statement":"' || statement || '","attributes":' || attributes || '}'""")} AS observation_id, payment_id AS subject_id, statement,
 CASE WHEN error_types <> '' THEN 'needs_review' ELSE 'keep' END AS decision, date AS event_date, source_id, party, reference FROM po0)"""
RELATIONS = """rel AS (SELECT 'building_in_property' AS relation, 'HAUS-' || n_nationkey AS from_id, 'LIE-' || n_regionkey AS to_id FROM nation
 UNION ALL SELECT 'tenant_of_building', 'MIE-' || c_custkey, 'HAUS-' || c_nationkey FROM customer
 UNION ALL SELECT 'contractor_at_building', 'DL-' || s_suppkey, 'HAUS-' || s_nationkey FROM supplier)"""
REL_OBS = f"""{RELATIONS}, ro0 AS (SELECT *, relation || ':' || from_id || ':' || to_id AS subject_id, 'Relationship ' || relation || ': ' || from_id || ' -> ' || to_id || '.' AS statement, list_sort(list_distinct([from_id, to_id, 'LIE-001'])) AS es FROM rel),
ro AS (SELECT {made_id("OBS", """'{"inputHash":"h0","kind":"relationship","sourceIds":["MASTER"],"statement":"' || statement || '","attributes":{"relationshipType":"' || relation || '","fromEntityId":"' || from_id || '","toEntityId":"' || to_id || '","primaryEntityId":"' || to_id || '","entities":' || to_json(es) || '}}'""")} AS observation_id,
 subject_id, statement, 'keep' AS decision, relation, from_id, to_id FROM ro0)"""
FACTS = f"""{PAY_OBS}, {REL_OBS}, o AS (SELECT 0 AS phase, 'payment' AS kind, observation_id, subject_id, statement, decision, event_date, source_id, subject_id AS primary_entity_id, NULL AS relationship_type, NULL AS from_entity_id, NULL AS to_entity_id FROM po
 UNION ALL SELECT 1, 'relationship', observation_id, subject_id, statement, decision, NULL, 'MASTER', to_id, relation, from_id, to_id FROM ro),
red AS (SELECT kind, subject_id, arg_min(statement, (phase, observation_id)) AS statement, arg_min(event_date, (phase, observation_id)) FILTER (WHERE event_date IS NOT NULL) AS event_date, min(primary_entity_id) AS primary_entity_id, min(relationship_type) AS relationship_type,
 min(from_entity_id) AS from_entity_id, min(to_entity_id) AS to_entity_id, CASE WHEN bool_or(decision = 'keep') THEN 'keep' ELSE 'needs_review' END AS decision, count(DISTINCT observation_id) AS merged, count(*) AS source_count, min(source_id) AS first_source FROM o GROUP BY kind, subject_id),
fact AS (SELECT {obs_id("FACT", kind="kind", subjectId="subject_id", statement="statement")} AS fact_id, * FROM red)"""
CHANGED = """pv AS (SELECT o_orderkey, o_orderstatus AS s, o_orderpriority AS p FROM orders WHERE o_orderkey % 5 <> 1),
fv AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 3 THEN 'X' ELSE o_orderstatus END AS s, o_orderpriority AS p FROM orders WHERE o_orderkey % 5 <> 2),
ch AS (SELECT COALESCE(pv.o_orderkey, fv.o_orderkey) AS o_orderkey, CASE WHEN pv.o_orderkey IS NULL THEN 'added' WHEN fv.o_orderkey IS NULL THEN 'removed' WHEN (pv.s, pv.p) <> (fv.s, fv.p) THEN 'modified' END AS status
 FROM pv FULL JOIN fv ON pv.o_orderkey = fv.o_orderkey)"""


def sections(name: str, edited: bool) -> str:
    shown = "n_name || CASE WHEN n_nationkey % 3 = 0 THEN '*' ELSE '' END" if edited else "n_name"
    return f"""{name}0 AS (SELECT r_name AS section_id, '## ' || r_name || chr(10) || string_agg('| ' || n_nationkey || ' | ' || {shown} || ' |', chr(10) ORDER BY n_nationkey) AS content FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name),
{name} AS (SELECT *, sha256(content) AS content_hash FROM {name}0)"""


MERGED = f"""{sections("s_old", False)}, {sections("s_new", True)},
ex AS (SELECT section_id, content || CASE WHEN section_id = 'EUROPE' THEN '!' ELSE '' END AS content, content_hash AS marked FROM s_old WHERE section_id <> 'ASIA'),
mg AS (SELECT n.section_id, CASE WHEN e.content IS NULL THEN 'append' WHEN sha256(e.content) <> e.marked THEN 'conflict' WHEN e.content = n.content THEN 'keep' ELSE 'replace' END AS action,
 e.content AS old, n.content AS fresh FROM s_new n LEFT JOIN ex e USING (section_id)),
mr AS (SELECT *, CASE WHEN action IN ('append', 'replace') THEN fresh ELSE old END AS content FROM mg)"""
FOLD = "lower(replace(replace(replace(replace({}, 'ß', 'ss'), 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue'))".format
SEARCH = ("trim(regexp_replace(lower(translate(replace(replace(replace(replace({}, 'ß', 'ss'), 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue'), "
          "'ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝàáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'AAAAAACEEEEIIIINOOOOOUUUUYaaaaaaceeeeiiiinooooouuuuyy')), '[^a-z0-9@._+-]+', ' ', 'g'))").format  # fmt: skip


# Typed here, not taken from the operators: the terms, folded, that the queries' texts can hold, and the categories' weights.
WEIGHTS = {"maintenance": 5, "dispute": 7, "finance": 4, "governance": 4, "contractor": 3, "deadline": 6, "access": 3, "risk": 8, "noise": -4}
TERMS = {
    "maintenance": "mangel schaden defekt reparatur instandsetzung wasser feuchtigkeit schimmel heizung strom tuer fenster dach keller aufzug treppenhaus sprechanlage schloss rohr leitung verstopfung".split(),
    "dispute": [*"beschwerde einspruch widerspruch streit minderung mahnung verzug rueckstand anwalt gericht fristsetzung kuendigung eskalation".split(), "nicht einverstanden"],
    "finance": "rechnung zahlung bezahlt offen faellig ueberweisung rueckerstattung gutschrift kaution miete hausgeld wirtschaftsplan betriebskosten nebenkosten sonderumlage saldo iban".split(),
    "governance": "etv versammlung beschluss protokoll tagesordnung top beirat verwaltung vollmacht mehrheit abstimmung".split(),
    "contractor": [*"angebot kostenvoranschlag auftrag beauftragt termin besichtigung monteur handwerker dienstleister firma ausfuehrung lieferung montage rueckmeldung".split(), "vor ort"],
    "deadline": [*"frist spaetestens deadline erinnerung heute morgen".split(), "bis zum", "rueckmeldung bis", "kommende woche", "naechste woche"],
    "access": [*"zugang schluessel terminvereinbarung anwesend mieter eigentuemer".split(), "wohnung betreten", "nicht erreichbar"],
    "risk": "gefahr sicherheit brand notfall evakuierung versicherung haftung polizei gesundheit unbewohnbar einsturz stromausfall".split(),
    "noise": [*"newsletter werbung abwesenheit empfangsbestaetigung fyi".split(), "automatische antwort", "zur kenntnis"],
}
DEEP_LIMIT = 25


def triage_scores() -> str:
    hits = {name: "(" + " OR ".join(f"contains(f, '{w}')" for w in words) + ")" for name, words in TERMS.items()}
    total = " + ".join(f"CASE WHEN {n} THEN {WEIGHTS[n]} ELSE 0 END" for n in hits)
    listed = ", ".join(f"CASE WHEN {n} THEN '{n}' END" for n in sorted(hits))
    real = " OR ".join(n for n in hits if n != "noise")
    columns = ", ".join(f"{h} AS {n}" for n, h in hits.items())
    added = "['', ' Die Heizung ist defekt.', ' Newsletter', ' Frist bis zum Montag, Gefahr', ' Überweisung der Miete', ' Einspruch! Anwalt'][doc_id % 6 + 1]"
    return f"""f AS (SELECT doc_id AS id, n_chars, {FOLD(f"(COALESCE(text, '') || {added})")} AS f FROM documents),
ht AS (SELECT id, n_chars, {columns} FROM f),
sc AS (SELECT id, concat_ws(',', {listed}) AS categories, CAST({total} AS BIGINT) AS score, ({real}) AND ({total}) > 0 AS actionable, noise,
 CAST(floor(n_chars / 1000) AS BIGINT) AS size FROM ht),
tr AS (SELECT *, score + least(size, 8) AS priority FROM sc)"""


SELECTED = f"""{triage_scores()}, rk AS (SELECT *, CASE WHEN actionable THEN row_number() OVER (PARTITION BY actionable ORDER BY priority DESC, size DESC, id) END AS k FROM tr),
sel AS (SELECT id, CASE WHEN actionable AND k <= {DEEP_LIMIT} THEN 'deep_extract' WHEN actionable THEN 'deferred' WHEN noise THEN 'ignore' ELSE 'metadata_only' END AS decision FROM rk)"""
QUEUE = """src AS (SELECT *, ['invoice_pdf', 'letter_pdf', 'bank_csv', 'master_data', 'index_csv'][doc_id % 5 + 1] AS k FROM documents),
mem AS (SELECT doc_id, 'S-' || doc_id AS source_id, CASE WHEN doc_id % 11 = 0 THEN 'incremental_day' WHEN k = 'invoice_pdf' THEN 'invoice_group' WHEN k = 'letter_pdf' THEN 'letter_group' WHEN k = 'bank_csv' THEN 'bank_group' ELSE 'master_data_bundle' END AS kind,
 CASE WHEN doc_id % 11 = 0 THEN 'day-01' WHEN k = 'invoice_pdf' THEN 'DL-' || doc_id % 7 || ':INV-' || doc_id % 50 WHEN k = 'letter_pdf' THEN CASE WHEN doc_id % 2 = 0 THEN '2024-01' ELSE '2024-0' || (doc_id % 9 + 1) END || ':typ' || doc_id % 4
 WHEN k = 'bank_csv' THEN 'base-bank-ledger' ELSE 'base-master-data-and-indexes' END AS group_key FROM src)"""

ALIAS_SQL = f"""WITH w0 AS (SELECT unnest(string_split(p_name, ' ')) AS w, 'name' AS k FROM part UNION ALL SELECT text, 'name' FROM benchmark UNION ALL SELECT 'a@b', 'email' UNION ALL SELECT 'der', 'email'),
w AS (SELECT DISTINCT w, k, {SEARCH('w')} AS folded FROM w0 WHERE w IS NOT NULL),
d AS (SELECT CAST(doc_id AS VARCHAR) AS source_id, {SEARCH('text')} AS t FROM documents)
SELECT DISTINCT source_id, sha256(w) AS entity, CASE WHEN k = 'email' THEN 'email' ELSE 'alias' END AS match_type FROM d JOIN w ON contains(t, folded) WHERE folded <> '' AND (k = 'email' OR length(folded) >= 5)"""
FACT_SQL = f"WITH {FACTS} SELECT fact_id, kind, subject_id, statement, decision, event_date, primary_entity_id, relationship_type, from_entity_id, to_entity_id, merged, source_count, first_source FROM fact"

ORACLES = {
    "inventory_hash": "SELECT doc_id, sha256(text) AS raw_sha256, CAST(length(text) AS BIGINT) AS chars FROM documents",
    "classify_sources": """SELECT page_id, CASE WHEN page_id % 4 = 0 AND url NOT LIKE '%/' THEN 'invoice_pdf' WHEN page_id % 4 = 1 AND url NOT LIKE '%/' THEN 'email' WHEN page_id % 4 = 2 THEN 'index_csv' ELSE 'unknown' END AS kind FROM pages""",
    "declared_ids": """WITH x AS (SELECT s_suppkey, 'INV-' || CASE WHEN s_suppkey % 3 = 0 THEN 'DUP-' ELSE '' END || s_nationkey AS inv FROM supplier)
SELECT s_suppkey, inv || ',DL-' || s_suppkey AS ids, '2024-01-01' AS date, 'DL-' || s_suppkey AS contractor_id, s_suppkey % 3 = 0 AS duplicate, inv AS source_id FROM x""",
    "source_id_collision": f"WITH {HASHED}, b AS (SELECT *, upper(source || '-' || lang) AS base_id FROM h) SELECT doc_id, CASE WHEN row_number() OVER (PARTITION BY base_id ORDER BY doc_id) = 1 THEN base_id ELSE base_id || '__' || substr(raw_sha256, 1, 8) END AS source_id FROM b",
    "exact_dedup": f"WITH {MARKED} SELECT doc_id, raw_sha256, duplicate_of FROM m",
    "duplicate_aliases": f"WITH {MARKED} SELECT duplicate_of AS doc_id, doc_id AS alias FROM m WHERE duplicate_of IS NOT NULL",
    "dedup_summary": f"WITH {REGISTRY} SELECT count(*) AS source_count, count(*) FILTER (WHERE status = 'duplicate') AS duplicate_count, count(*) FILTER (WHERE status = 'ignored') AS ignored_count FROM r",
    "status_sync": f"WITH {REGISTRY} SELECT doc_id, status FROM r",
    "manifest_diff": f"WITH {VERSIONS} SELECT COALESCE(c.o_orderkey, p.o_orderkey) AS o_orderkey, CASE WHEN c.o_orderkey IS NULL THEN 'deleted' WHEN p.raw_sha256 <> c.raw_sha256 THEN 'changed' ELSE 'discovered' END AS status, COALESCE(c.raw_sha256, p.raw_sha256) AS raw_sha256 FROM c FULL JOIN p ON c.o_orderkey = p.o_orderkey",
    "reuse_split": f"WITH {HASHED}, p AS (SELECT * FROM h WHERE doc_id % 3 <> 0) SELECT 'reused' AS part, doc_id AS id FROM p UNION ALL SELECT 'fresh', doc_id FROM h WHERE raw_sha256 NOT IN (SELECT raw_sha256 FROM p)",
    "coverage": """WITH l AS (SELECT doc_id, count(*) AS n FROM labels GROUP BY doc_id), j AS (SELECT d.doc_id AS d, l.doc_id AS l, n FROM (SELECT DISTINCT doc_id FROM documents) d FULL JOIN l ON d.doc_id = l.doc_id),
c AS (SELECT count(d) AS expected, count(*) FILTER (WHERE d IS NOT NULL AND l IS NOT NULL) AS assigned, count(*) FILTER (WHERE l IS NULL) AS missing, count(*) FILTER (WHERE d IS NULL) AS unknown, count(*) FILTER (WHERE n > 1) AS repeated FROM j)
SELECT *, CASE WHEN missing + unknown + repeated = 0 THEN 'PASS' ELSE 'FAIL' END AS result FROM c""",
    "coverage_report": """WITH e AS (SELECT DISTINCT doc_id FROM labels), a AS (SELECT doc_id, count(*) AS n FROM documents GROUP BY doc_id), j AS (SELECT e.doc_id AS d, a.doc_id AS l, n FROM e FULL JOIN a ON e.doc_id = a.doc_id),
c AS (SELECT count(d) AS expected, count(*) FILTER (WHERE d IS NOT NULL AND l IS NOT NULL) AS assigned, count(*) FILTER (WHERE l IS NULL) AS missing, count(*) FILTER (WHERE d IS NULL) AS unknown, count(*) FILTER (WHERE n > 1) AS repeated FROM j)
SELECT concat_ws(chr(10), '# Coverage', '', 'Result: ' || CASE WHEN missing + unknown + repeated = 0 THEN 'PASS' ELSE 'FAIL' END, '- expected: ' || expected, '- assigned: ' || assigned, '- missing: ' || missing, '- unknown: ' || unknown, '- repeated: ' || repeated) AS text FROM c""",
    "delta_listing": f"SELECT {DAY('ts')} AS day, count(*) AS files, CAST(sum(length(props)) AS BIGINT) AS bytes, {DAY('ts')} <= (SELECT max({DAY('ts')}) FROM events WHERE event_id % 5 = 0 AND event_id % 2 <> 0) AS applied FROM events GROUP BY 1",
    "thread_group": "SELECT conv_id, count(*) AS source_count, min(lpad(CAST(turn AS VARCHAR), 6, '0') || ':' || role) AS first_source, max(lpad(CAST(turn AS VARCHAR), 6, '0') || ':' || role) AS last_source, 'WI-EMAIL_THREAD-' || conv_id AS work_item_id FROM conversations GROUP BY conv_id",
    "thread_glimpse": """WITH k AS (SELECT conv_id, string_agg(role || '=' || n, ',' ORDER BY role) AS kinds FROM (SELECT conv_id, role, count(*) AS n FROM conversations GROUP BY conv_id, role) GROUP BY conv_id),
h AS (SELECT DISTINCT conv_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS h FROM conversations WHERE text IS NOT NULL),
hk AS (SELECT conv_id, h FROM h WHERE h <> '' QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY h) <= 4),
g AS (SELECT conv_id, count(*) AS source_count, min(turn) AS first_date, max(turn) AS last_date FROM conversations GROUP BY conv_id)
SELECT g.*, kinds, COALESCE((SELECT string_agg(h, ',' ORDER BY h) FROM hk WHERE hk.conv_id = g.conv_id), '') AS hints FROM g JOIN k USING (conv_id)""",
    "thread_root": """WITH RECURSIVE n AS (SELECT DISTINCT conv_id, turn FROM conversations), w AS (SELECT conv_id, turn, turn AS up FROM n UNION ALL SELECT w.conv_id, w.turn, n.turn FROM w JOIN n ON n.conv_id = w.conv_id AND n.turn = w.up - 1)
SELECT conv_id || ':' || lpad(CAST(turn AS VARCHAR), 6, '0') AS node, conv_id || ':' || lpad(CAST(min(up) AS VARCHAR), 6, '0') AS root FROM w GROUP BY conv_id, turn""",
    "mail_threads": """WITH RECURSIVE n AS (SELECT DISTINCT conv_id, turn FROM conversations), w AS (SELECT conv_id, turn, turn AS up FROM n UNION ALL SELECT w.conv_id, w.turn, n.turn FROM w JOIN n ON n.conv_id = w.conv_id AND n.turn = w.up - 2)
SELECT conv_id || ':' || min(up) AS thread_key, lpad(CAST(conv_id AS VARCHAR), 8, '0') || ':' || lpad(CAST(turn AS VARCHAR), 4, '0') AS member FROM w GROUP BY conv_id, turn""",
    "invoice_group": "SELECT l_suppkey, l_orderkey, count(*) AS source_count, min(l_orderkey || '-' || l_linenumber || '-' || l_partkey) AS first_source, max(l_orderkey || '-' || l_linenumber || '-' || l_partkey) AS last_source, 'WI-INVOICE_GROUP-' || l_suppkey || '-' || l_orderkey AS work_item_id FROM lineitem GROUP BY 1, 2",
    "letter_group": f"SELECT strftime(o_orderdate, '%Y-%m') AS month, o_orderpriority, count(*) AS letters, min({DAY('o_orderdate')}) AS first_date, max({DAY('o_orderdate')}) AS last_date FROM orders GROUP BY 1, 2",
    "daily_drop": f"SELECT {DAY('ts')} AS day, event_type, count(*) AS events, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total FROM events GROUP BY 1, 2",
    "alias_multimap": "SELECT DISTINCT lower(trim(a)) AS alias_key, entity_id, 'name' AS alias_type FROM (SELECT c_name AS a, 'MIE-' || c_custkey AS entity_id FROM customer UNION ALL SELECT s_name, 'DL-' || s_suppkey FROM supplier UNION ALL SELECT p_name, 'PART-' || p_partkey FROM part) WHERE trim(a) <> ''",
    "entity_index": f"WITH {INDEX} SELECT entity_id, entity_type, name, array_to_string(related, ',') AS related FROM index_",
    "entity_stats": f"WITH {INDEX} SELECT entity_type, count(*) AS entities FROM index_ GROUP BY 1",
    "relation_edges": f"WITH {INDEX}, {EDGES} SELECT from_id, to_id FROM edges",
    "mention_join": r"""WITH x AS (SELECT doc_id, unnest(regexp_extract_all('ref DL-' || doc_id % 400 || ', MIE-' || doc_id % 7000 || ' ' || COALESCE(text, ''), '\b(?:LIE|HAUS|EH|EIG|MIE|DL|TX|INV|EMAIL|LTR)-[A-Z0-9-]*\d+\b')) AS entity_id FROM documents)
SELECT DISTINCT doc_id AS source_id, entity_id, 'mention' AS match_type FROM x WHERE entity_id IN (SELECT 'DL-' || s_suppkey FROM supplier UNION SELECT 'MIE-' || c_custkey FROM customer)""",
    "mail_address_join": r"WITH x AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9._+-]+@[a-z0-9-]+(?:\.[a-z0-9-]+)+')) AS email FROM documents) SELECT email, count(*) AS documents, min(doc_id) AS first_doc FROM x GROUP BY email",
    "alias_contains": ALIAS_SQL,
    "closure": f"WITH RECURSIVE {CLOSURE} SELECT * FROM closure",
    "temporal_validity": f"WITH r AS (SELECT l_orderkey, min(l_shipdate) AS a, max(l_shipdate) AS b FROM lineitem GROUP BY 1) SELECT o_orderkey, {DAY('a')} AS valid_from, {DAY('b')} AS valid_to FROM orders JOIN r ON o_orderkey = l_orderkey WHERE o_orderdate + INTERVAL 30 DAYS BETWEEN a AND b",
    "link_decision": f"""WITH RECURSIVE {CLOSURE}, k AS (SELECT source_id, bool_or(entity_type NOT IN ('property', 'email', 'letter')) AS strong, count(*) AS n FROM closure JOIN index_ USING (entity_id) GROUP BY 1)
SELECT CAST(o_orderkey AS VARCHAR) AS source_id, CASE WHEN strong THEN 'linked' WHEN n > 0 THEN 'property_only' ELSE 'unlinked' END AS decision, COALESCE(n, 0) AS candidate_count FROM orders LEFT JOIN k ON source_id = CAST(o_orderkey AS VARCHAR)""",
    "link_summary": f"""WITH RECURSIVE {CLOSURE}, k AS (SELECT DISTINCT source_id FROM closure)
SELECT count(source_id) AS linked, CAST(0 AS BIGINT) AS property_only, count(*) - count(source_id) AS unlinked, CAST(0 AS BIGINT) AS ambiguous FROM orders LEFT JOIN k ON source_id = CAST(o_orderkey AS VARCHAR)""",
    "relationships": f"WITH {REL_OBS} SELECT observation_id, statement, decision, array_to_string(list_sort(list_distinct(regexp_extract_all(statement || ' LIE-001', '(?:LIE|HAUS|MIE|DL)-[0-9]+'))), ',') AS mentions FROM ro",
    "entity_profiles": f"""WITH m AS (SELECT 'building ' || 'HAUS-' || n_nationkey || ' (' || n_name || ') is present in canonical master data.' AS statement, '{{"entityId":"HAUS-' || n_nationkey || '","entityType":"building","fields":{{"id":"HAUS-' || n_nationkey || '","name":' || to_json(n_name) || '}}}}' AS a FROM nation
 UNION ALL SELECT 'tenant MIE-' || c_custkey || ' (' || c_mktsegment || ' ' || c_name || ') is present in canonical master data.', '{{"entityId":"MIE-' || c_custkey || '","entityType":"tenant","fields":{{"id":"MIE-' || c_custkey || '","vorname":' || to_json(c_mktsegment) || ',"nachname":' || to_json(c_name) || ',"einheit_id":"EH-' || c_nationkey || '","mietbeginn":"1994-01-01"}}}}' FROM customer
 UNION ALL SELECT 'contractor DL-' || s_suppkey || ' (' || s_name || ') is present in canonical master data.', '{{"entityId":"DL-' || s_suppkey || '","entityType":"contractor","fields":{{"id":"DL-' || s_suppkey || '","firma":' || to_json(s_name) || '}}}}' FROM supplier)
SELECT {made_id("OBS", """'{"inputHash":"h0","kind":"entity_profile","sourceIds":["MASTER"],"statement":' || to_json(statement) || ',"attributes":' || a || '}'""")} AS observation_id, statement, 'entity_profile' AS kind FROM m""",
    "payment_obs": f"WITH {PAY_OBS} SELECT observation_id, source_id, statement, decision, array_to_string(list_sort(list_distinct([subject_id, party, reference, 'LIE-001'])), ',') AS mentions FROM po",
    "invoice_review": f"""WITH x AS (SELECT 'INV-' || CASE WHEN o_orderkey % 11 = 0 THEN 'DUP-' ELSE '' END || o_orderkey AS subject_id, * FROM orders)
SELECT subject_id, 'Invoice ' || subject_id || ' (' || o_orderkey || ') is dated ' || {DAY('o_orderdate')} || ' for DL-' || o_custkey || ' with gross amount ' || CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) || CASE WHEN o_orderstatus = 'F' THEN ', VAT 19%' ELSE '' END || '.' AS statement,
 CASE WHEN o_orderkey % 11 = 0 THEN 'needs_review' ELSE 'keep' END AS decision, subject_id AS primary_entity_id, 'invoice' AS fact_kind FROM x""",
    "money_parse": """WITH x AS (SELECT s_suppkey, CAST(s_acctbal AS DECIMAL(18,2)) AS v FROM supplier), y AS (SELECT *, translate(format('{:,.2f}', CAST(v AS DOUBLE)), ',.', '.,') AS g FROM x)
SELECT s_suppkey, CAST(v AS DOUBLE) AS amount, CAST(COALESCE(TRY_CAST(CASE WHEN contains(substr(g, 1, 3), ',') THEN replace(replace(substr(g, 1, 3), '.', ''), ',', '.') ELSE substr(g, 1, 3) END AS DECIMAL(18,2)), 0) AS DOUBLE) AS cut FROM y""",
    "date_normalize": f"SELECT o_orderkey, {DAY('o_orderdate')} AS from_german, {DAY('o_orderdate + INTERVAL 1 DAY')} AS from_mail, epoch_ms(CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP)) AS millis FROM orders",
    "fact_reduce": FACT_SQL,
    "view_mentions": "SELECT o_orderkey, 'TX-' || o_orderkey || ',FACT-' || o_orderkey % 7 || ',WI-9' || CASE WHEN o_orderkey % 5 = 0 THEN (SELECT string_agg(',INV-' || i || 'X' || o_orderkey, '' ORDER BY i) FROM range(15) r(i)) ELSE '' END AS ids FROM orders",
    "split_lists": "SELECT p_partkey, replace(p_name, ' ', '|') AS parts, array_to_string(list_sort(list_distinct(string_split(p_name, ' '))), '|') AS sorted FROM part",
    "human_sizes": """WITH s AS (SELECT o_orderkey, CAST(floor(o_totalprice * CASE o_orderkey % 3 WHEN 0 THEN 0.01 WHEN 1 THEN 1 ELSE 100 END) AS BIGINT) AS c FROM orders), q AS (SELECT *, CAST(floor(c * 10 / 1024.0 + 0.5) AS BIGINT) AS k, CAST(floor(c * 10 / 1048576.0 + 0.5) AS BIGINT) AS m FROM s)
SELECT o_orderkey, CASE WHEN c < 1024 THEN c || ' B' WHEN c < 1048576 THEN k // 10 || '.' || k % 10 || ' KB' ELSE m // 10 || '.' || m % 10 || ' MB' END AS shown FROM q""",
    "message_ids": "SELECT o_orderkey, CASE WHEN o_orderkey % 9 <> 0 THEN lower(o_orderpriority) || '@mail.' || o_orderkey END AS message_id FROM orders",
    "markdown_parts": r"SELECT p_partkey, replace(p_name, ' ', '|') AS titles, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w) || '|b'), '|') AS bullets, array_to_string(list_transform(string_split(p_name, ' '), lambda w: 'a/b|' || w || '/x\|y'), '|') AS cells FROM part",
    "work_item_outcomes": "SELECT 'WI-' || o_orderkey AS work_item_id, CASE WHEN o_orderpriority LIKE '1%' THEN 'error' WHEN o_orderstatus = 'F' THEN 'processed' WHEN o_orderpriority LIKE '2%' THEN 'ignored' WHEN o_orderpriority NOT LIKE '3%' THEN 'processed' ELSE 'queued' END AS status FROM orders",
    "alias_delta": ALIAS_SQL,
    "fact_delta": FACT_SQL,
    "fact_order": f"WITH {FACTS} SELECT fact_id, row_number() OVER (ORDER BY kind || ':' || subject_id COLLATE en, fact_id) - 1 AS place FROM fact",
    "candidate_order": """SELECT *, row_number() OVER (ORDER BY source_id COLLATE en, 'contractor:' || entity_id || ':' || match_type COLLATE en, evidence) - 1 AS place
 FROM (SELECT 'S-' || l_orderkey AS source_id, 'DL-' || l_suppkey AS entity_id, p_brand AS match_type, p_name || ' #' || l_linenumber AS evidence FROM lineitem JOIN part ON l_partkey = p_partkey)""",
    "fact_id": f"WITH x AS (SELECT o_orderkey, 'INV-' || o_orderkey AS s, 'Invoice INV-' || o_orderkey || ' is dated ' || {DAY('o_orderdate')} || '.' AS t FROM orders) SELECT o_orderkey, {obs_id('FACT', kind=chr(39) + 'invoice' + chr(39), subjectId='s', statement='t')} AS fact_id FROM x",
    "fact_stats": f"WITH {FACTS} SELECT kind, count(*) AS facts FROM fact GROUP BY kind",
    "last_fact_per_subject": "SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id",
    "facts_by_entity": "SELECT entity_id, count(*) AS facts FROM (SELECT 'DL-' || l_suppkey AS entity_id FROM lineitem UNION ALL SELECT 'PART-' || l_partkey FROM lineitem) GROUP BY 1",
    "change_set": f"WITH {CHANGED} SELECT o_orderkey, status FROM ch WHERE status IS NOT NULL",
    "affected_views": f"""WITH {CHANGED}, k AS (SELECT CASE o_orderstatus WHEN 'F' THEN 'financials' WHEN 'O' THEN 'documents' ELSE 'communications-review' END AS section, o_custkey FROM ch JOIN orders USING (o_orderkey) WHERE status IS NOT NULL)
SELECT DISTINCT 'contexts/LIE-001/Context.md#' || section AS view FROM k UNION SELECT 'contexts/LIE-001/entities/MIE-' || o_custkey || '.md' FROM k WHERE o_custkey IN (SELECT c_custkey FROM customer) UNION SELECT 'contexts/LIE-001/view-manifest.json' FROM k""",
    "financial_summary": f"WITH {PAYMENTS} SELECT count(*) AS payments, CAST(sum(signed) FILTER (WHERE signed > 0) AS DOUBLE) AS inflow, CAST(sum(signed) FILTER (WHERE signed < 0) AS DOUBLE) AS outflow, min(date) AS first_date, max(date) AS last_date FROM signed",
    "payments_per_party": f"WITH {PAYMENTS} SELECT party, s_name, count(*) AS payments, CAST(sum(signed) AS DOUBLE) AS balance, min(date) AS first_date, max(date) AS last_date FROM signed JOIN supplier ON party = 'DL-' || s_suppkey GROUP BY party, s_name",
    "category_topk": "SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, 1 LIMIT 3",
    "recent_payments": f"WITH {PAYMENTS} SELECT payment_id, date, source_id, CAST(signed AS DOUBLE) AS signed FROM signed ORDER BY date DESC, payment_id, source_id LIMIT 30",
    "entity_recent_facts": "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY strftime(o_orderdate, '%Y-%m-%d') DESC, o_orderkey) AS rank FROM orders QUALIFY rank <= 3",
    "view_manifest": "WITH p AS (SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY strftime(o_orderdate, '%Y-%m-%d') DESC, o_orderkey) <= 3) SELECT 'entity:' || o_custkey AS view, count(*) AS fact_count, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY CAST(o_orderkey AS VARCHAR)) AS depends_on FROM p GROUP BY o_custkey",
    "reverse_lookup": "SELECT n_name, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS customers, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS suppliers, (SELECT min(s_name) FROM supplier WHERE s_nationkey = n_nationkey) AS first_supplier FROM nation",
    "section_render": f"WITH {sections('s', False)} SELECT section_id, content, content_hash FROM s",
    "section_merge": f"WITH {MERGED} SELECT section_id, action, CAST(length(content) AS BIGINT) AS chars FROM mr",
    "patch_log": f"WITH {MERGED} SELECT section_id, action, sha256(old) AS before_hash, sha256(content) AS after_hash FROM mr WHERE action <> 'keep'",
    "user_blocks": "SELECT page_id, CAST(2 AS BIGINT) AS blocks, CAST(length('<USER id=\"1\">' || COALESCE(html, '') || '</User><user>' || COALESCE(url, '') || '</user>') AS BIGINT) AS chars, TRUE AS unchanged, FALSE AS edited FROM pages",
    "graph_edges": f"WITH {RELATIONS} SELECT DISTINCT from_id, to_id, relation AS label FROM rel WHERE from_id NOT LIKE 'MIE-%'",
    "graph_neighbourhood": f"""WITH {INDEX}, {RELATIONS}, near AS (SELECT DISTINCT CASE WHEN from_id = 'HAUS-3' THEN to_id ELSE from_id END AS id FROM rel WHERE 'HAUS-3' IN (from_id, to_id)),
kept AS ((SELECT entity_id AS id FROM index_ WHERE entity_id IN (SELECT id FROM near) ORDER BY entity_type, entity_id LIMIT 41) UNION ALL SELECT 'HAUS-3')
SELECT DISTINCT from_id, to_id, relation AS label FROM rel WHERE from_id IN (SELECT id FROM kept) AND to_id IN (SELECT id FROM kept) ORDER BY 1, 2, 3 LIMIT 90""",
    "relation_notes": f"WITH {RELATIONS}, r AS (SELECT to_id AS from_id, relation AS label, from_id AS t FROM rel QUALIFY row_number() OVER (PARTITION BY to_id, relation ORDER BY from_id) <= 3) SELECT from_id, label, string_agg(t, ', ' ORDER BY t) AS note FROM r GROUP BY 1, 2",
    "triage_score": f"WITH {triage_scores()} SELECT id, categories, score, actionable, priority FROM tr",
    "triage_select": f"WITH {SELECTED} SELECT id, decision FROM sel",
    "semantic_default": f"WITH {SELECTED} SELECT id, 'needs_review' AS decision FROM sel WHERE decision = 'deep_extract'",
    "json_fields": "SELECT event_id, json_extract_string(props, '$.k') AS k, CAST(NULL AS VARCHAR) AS absent FROM events",
    "folded_text": rf"""SELECT doc_id, sha256({FOLD("COALESCE(text, '')")}) AS folded, substr(regexp_replace(regexp_replace(COALESCE(text, ''), '[^A-Za-z0-9_-]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 120) AS stem,
 sha256(regexp_replace(regexp_replace('aw:  ' || lower(COALESCE(text, '')), '\s+', ' ', 'g'), '^ | $', '', 'g')) AS subject, '2024-0' || (doc_id % 9 + 1) AS month FROM documents""",
    "conversation_titles": "SELECT conv_id, COALESCE(nullif(substr(arg_min(text, turn) FILTER (WHERE role = 'user' AND text IS NOT NULL), 1, 48), ''), 'Thread ' || substr(CAST(conv_id AS VARCHAR), 1, 6)) AS title FROM conversations GROUP BY conv_id",
    "shown_messages": "SELECT role, count(*) AS messages FROM conversations WHERE role IS DISTINCT FROM 'tool' GROUP BY role",
    "newest_conversations": "SELECT conv_id, max(turn) AS latest FROM conversations GROUP BY conv_id ORDER BY latest DESC, conv_id LIMIT 12",
    "gated_closure": f"""WITH RECURSIVE {CLOSURE} SELECT c.* FROM closure c JOIN orders o ON c.source_id = CAST(o_orderkey AS VARCHAR)
WHERE CAST(o_orderdate AS DATE) <= DATE '1995-01-01' + CAST(o_custkey % 1500 AS INTEGER)""",
    "item_candidates": f"""WITH RECURSIVE {CLOSURE} SELECT 'WI-' || o_custkey AS work_item_id, entity_id, 'work_item_aggregate' AS match_type, inherited_from, count(DISTINCT source_id) AS sources
FROM closure JOIN orders ON source_id = CAST(o_orderkey AS VARCHAR) GROUP BY ALL""",
    "last_candidates": "SELECT l_orderkey AS source_id, 'DL-' || l_suppkey AS entity_id, l_returnflag AS evidence, CAST(max(l_linenumber) AS BIGINT) AS reason FROM lineitem GROUP BY 1, 2, 3",
    "master_relations": "SELECT 'property_has_building' AS relation, 'LIE-001' AS from_id, 'HAUS-' || n_nationkey AS to_id, NULL AS valid_from, NULL AS valid_to FROM nation UNION ALL SELECT 'tenant_occupied_unit', 'MIE-' || c_custkey, 'EH-' || c_nationkey, '1994-01-01', NULL FROM customer",
    "owner_units": "SELECT 'owner_owned_unit' AS relation, 'EIG-' || s_suppkey AS from_id, 'EH-' || (s_suppkey * k % 97) AS to_id FROM supplier, (SELECT unnest([1, 2, 3]) AS k)",
    "statement_rows": f"SELECT 'Payment row-' || o_orderkey || ' is ' || o_orderpriority || ' ' || CAST(o_totalprice AS DECIMAL(18,2)) || ' on ' || {DAY('o_orderdate')} || ' with unknown counterparty.' AS statement, 'keep' AS decision FROM orders",
    "mail_obs": """WITH x AS (SELECT *, CASE WHEN turn % 2 = 0 THEN 'THR-' || conv_id END AS thr, 'EMAIL-' || conv_id AS em FROM conversations)
SELECT 'Email ' || em || CASE WHEN thr IS NULL THEN '' ELSE ' in thread ' || thr END || ' is dated ' || turn || ' with subject ' || role || '.' AS statement, 'needs_review' AS decision, COALESCE(thr, em) AS subject_id,
 array_to_string(list_sort(list_filter([em, 'LIE-001', thr], lambda v: v IS NOT NULL)), ',') AS entities FROM x""",
    "letter_obs": f"""SELECT 'Letter LTR-' || o_orderkey || ' is a ' || lower(o_orderpriority) || ' document dated ' || {DAY('o_orderdate')} || CASE WHEN o_orderstatus = 'F' THEN ' about Mahnung' ELSE '' END || CASE WHEN o_orderkey % 3 = 0 THEN ' with 2 extracted meeting decision(s)' ELSE '' END
 || CASE WHEN o_orderstatus = 'O' THEN ' and amount 1.00' ELSE '' END || '.' AS statement, 'keep' AS decision, 'document_metadata' AS kind FROM orders""",
    "fact_sources": f"WITH {FACTS} SELECT DISTINCT fact_id, source_id FROM o JOIN fact USING (kind, subject_id)",
    "fact_entities": f"""WITH {FACTS}, e AS (SELECT 'payment' AS kind, subject_id, unnest([subject_id, party, reference, 'LIE-001']) AS entity_id FROM po UNION ALL SELECT 'relationship', subject_id, unnest([from_id, to_id, 'LIE-001', subject_id]) FROM ro)
SELECT DISTINCT fact_id, entity_id FROM e JOIN fact USING (kind, subject_id)""",
    "fact_kinds": """WITH k AS (SELECT event_id, ['relationship', 'maintenance_issue', 'meeting_decision', 'payment', 'invoice', 'document_metadata', 'communication_metadata', 'source_bundle', 'issue', 'decision', 'obligation', 'deadline', 'risk', 'status_change', 'communication_event', 'entity_profile', 'odd'][event_id % 17 + 1] AS observed,
 ['property', 'building', 'unit', 'owner', 'tenant', 'contractor', 'letter'][user_id % 7 + 1] AS e FROM events)
SELECT observed, CASE observed WHEN 'maintenance_issue' THEN 'issue' WHEN 'meeting_decision' THEN 'decision' WHEN 'document_metadata' THEN 'document' WHEN 'communication_metadata' THEN 'communication' WHEN 'odd' THEN 'review_item'
 WHEN 'entity_profile' THEN CASE e WHEN 'property' THEN 'property_profile' WHEN 'letter' THEN 'review_item' ELSE e END ELSE observed END AS kind, count(*) AS n FROM k GROUP BY 1, 2""",
    "change_summary": f"WITH {CHANGED} SELECT count(*) FILTER (WHERE status IS DISTINCT FROM 'added') AS previous, count(*) FILTER (WHERE status IS DISTINCT FROM 'removed') AS following, count(*) FILTER (WHERE status = 'added') AS added, count(*) FILTER (WHERE status = 'removed') AS removed, count(*) FILTER (WHERE status = 'modified') AS modified, count(*) FILTER (WHERE status IS NULL) AS unchanged FROM ch",
    "changed_entities": f"WITH {CHANGED}, k AS (SELECT o_orderkey, o_custkey FROM ch JOIN orders USING (o_orderkey) WHERE status IS NOT NULL) SELECT 'INV-' || o_orderkey AS entity_id FROM k UNION SELECT 'MIE-' || o_custkey FROM k UNION SELECT 'LIE-001' FROM k",
    "protected_edits": r"""SELECT doc_id, sha256('<user author="a-b-' || source || '">' || chr(10) || regexp_replace(regexp_replace(' </ user>' || COALESCE(text, '') || '</ user> ', '^\s+', ''), '\s+$', '') || chr(10) || '</user>') AS block FROM documents""",
    "section_markers": r"SELECT doc_id, 's' || doc_id AS section_id, sha256(regexp_replace(COALESCE(text, ''), '\s+$', '')) AS marked_hash, TRUE AS whole FROM documents",
    "note_append": """WITH x AS (SELECT *, '- T agent note: look' || chr(10) || '  Reason: why' AS e, '## Human And Agent Notes' AS h FROM nation)
SELECT n_nationkey, replace(CASE n_nationkey % 3 WHEN 0 THEN '# Context~~' || h || '~~' || e || '~~old~' || n_name || '~' WHEN 1 THEN '# Context~~' || h || '~~' || e || '~~<!-- BCE:SECTION a START hash=0 -->~' || n_name || '~' ELSE '# Context~~' || n_name || '~~' || h || '~~' || e || '~~' END, '~', chr(10)) AS text FROM x""",
    "triage_decisions": f"""WITH b AS (SELECT CAST(o_orderkey AS VARCHAR) AS work_item_id, o_orderkey % 2 = 0 AS mail, o_orderstatus AS s, CASE WHEN o_orderstatus = 'F' THEN 11 + least(o_orderkey % 11, 8) END AS p, o_orderkey % 11 AS size FROM orders),
r AS (SELECT *, row_number() OVER (PARTITION BY mail AND s = 'F' ORDER BY p DESC, size DESC, work_item_id) AS k FROM b),
d AS (SELECT work_item_id, CASE WHEN NOT mail OR s NOT IN ('F', 'O') THEN '' WHEN s = 'F' THEN 'dispute,finance' ELSE 'noise' END AS categories, CASE WHEN NOT mail THEN 'metadata_only' WHEN s = 'F' THEN CASE WHEN k <= 25 THEN 'needs_review' ELSE 'deferred' END WHEN s = 'O' THEN 'ignore' ELSE 'metadata_only' END AS decision,
 CASE WHEN NOT mail THEN 'Non-email work item is handled by deterministic extractors in this pass.' WHEN s = 'F' AND k <= 25 THEN 'High-signal thread selected, but no extractor is available.' WHEN s = 'F' THEN 'High-signal thread deferred after bounded selection limit 25.' ELSE 'Email thread has no high-signal property-management terms after deterministic triage.' END AS reason FROM r)
SELECT work_item_id, categories, decision, {made_id("SEMDEC", """'{"workItemId":"' || work_item_id || '","inputHash":"h","decision":"' || decision || '","reason":"' || reason || '"}'""")} AS decision_id FROM d""",
    "semantic_filter": """SELECT CAST(o_orderkey AS VARCHAR) AS work_item_id, 'issue' AS kind, 'needs_review' AS decision, 'LIE-001,MIE-' || o_custkey AS mentions, 'MIE-' || o_custkey AS "primary", 'q' AS quote, 'EMAIL-' || o_orderkey AS source_id FROM orders WHERE o_orderkey % 3 <> 0 OR o_orderkey = 0""",
    "searched_text": rf"""SELECT doc_id, sha256({SEARCH("COALESCE(text, '')")}) AS folded, sha256(regexp_replace(regexp_replace(regexp_replace(regexp_replace(COALESCE(text, ''), '[ \t]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+', ''), '\s+$', '')) AS spaced FROM documents""",
    "pdf_fields": """SELECT o_orderkey, 'RE-' || o_orderkey AS invoice_number, 'K' || o_custkey AS customer_number, strftime(o_orderdate, '%d.%m.%Y') AS invoice_date, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS net_amount, CAST(NULL AS VARCHAR) AS vat_amount, '1.50' AS gross_amount,
 'DE02 1203 0000 0000 2020 51' AS iban, 'Rechnung RE-' || o_orderkey AS title FROM orders""",
    "letter_names": """WITH x AS (SELECT o_orderkey, o_orderkey % 2 = 0 AS fits, 'etv_' || lower(regexp_replace(o_orderpriority, '[^A-Za-z]', '', 'g')) AS k FROM orders)
SELECT o_orderkey, 'letter_pdf' AS kind, CASE WHEN fits THEN '2024-01-31' END AS date, CASE WHEN fits THEN k END AS letter_type, CASE WHEN fits THEN 'LTR-' || o_orderkey END AS letter_id FROM x""",
    "table_render": """WITH x AS (SELECT n_regionkey, string_agg('| ' || n_name || ' | a\\|b' || n_nationkey || ' |', chr(10) ORDER BY n_name) AS rows, list(n_name ORDER BY n_name) AS names FROM nation GROUP BY 1)
SELECT r_name, CASE WHEN r_name = 'ASIA' OR rows IS NULL THEN '_No facts available yet._' ELSE '| Name | Key |' || chr(10) || '| --- | --- |' || chr(10) || rows END AS text,
 CASE WHEN r_name = 'ASIA' OR rows IS NULL THEN '' ELSE '[' || array_to_string(names[1:4], ', ') || CASE WHEN len(names) > 4 THEN ', ...' ELSE '' END || ']' END AS ref FROM region LEFT JOIN x ON r_regionkey = n_regionkey""",
    "chat_rows": """WITH m AS (SELECT conv_id AS thread_id, turn, CASE role WHEN 'user' THEN 'human' WHEN 'assistant' THEN 'ai' ELSE 'tool' END AS k, COALESCE(text, '') AS t FROM conversations),
r AS (SELECT thread_id, 'user' AS role, t AS c FROM m WHERE k = 'human' UNION ALL SELECT thread_id, 'agent', t FROM m WHERE k = 'ai' AND trim(t) <> '' UNION ALL SELECT thread_id, 'tool', '[tool call: find, query:{"n":' || turn || '}]' FROM m WHERE k = 'ai' AND turn % 2 = 0
 UNION ALL SELECT thread_id, 'tool', '[tool result: tool_result] ' || t FROM m WHERE k = 'tool')
SELECT thread_id, role, count(*) AS n, CAST(sum(length(c)) AS BIGINT) AS chars FROM r GROUP BY 1, 2""",
    "activity_rows": """SELECT CASE WHEN turn % 3 = 0 THEN 'tool_result' ELSE 'model' END AS phase, CASE WHEN turn % 3 = 0 THEN 'find' ELSE 'agent_reasoning' END AS label, count(*) AS n, CAST(sum(CASE WHEN turn % 3 = 0 THEN least(length(COALESCE(text, '')), 180) ELSE 27 END) AS BIGINT) AS chars FROM conversations GROUP BY 1, 2""",
    "context_provenance": f"""WITH {FACTS}, n AS (SELECT kind, CAST(count(*) AS VARCHAR) AS n FROM (SELECT kind, subject_id FROM fact UNION ALL SELECT 'building', CAST(n_nationkey AS VARCHAR) FROM nation UNION ALL SELECT 'tenant', CAST(c_custkey AS VARCHAR) FROM customer UNION ALL SELECT 'contractor', CAST(s_suppkey AS VARCHAR) FROM supplier UNION ALL SELECT 'invoice', CAST(o_orderkey AS VARCHAR) FROM orders) GROUP BY 1),
f AS (SELECT unnest(['- Context.md is a materialized view, not the source of truth.', '- Source registry: contexts/LIE-001/source-registry.json', '- Entity index: contexts/LIE-001/entity-index.json', '- Fact index: contexts/LIE-001/fact-index.json', '- Entity links: workdir/entity-links/entity-links.jsonl', '- Observations: workdir/observations/observations.jsonl',
 '- Semantic observations: workdir/semantic/observations.jsonl', '- Latest change set: workdir/changes/latest-change-set.json', '- Entity context views: contexts/LIE-001/entities/*.md', '- Patch log: contexts/LIE-001/patch-log.jsonl', '']) AS line, unnest(range(11)) AS k)
SELECT 'provenance' AS section_id, CAST(0 AS INTEGER) AS part, lpad(CAST(k AS VARCHAR), 4, '0') AS place, line FROM f UNION ALL SELECT 'provenance', 1, '0000', '| Fact kind | Count |' UNION ALL SELECT 'provenance', 1, '0001', '| --- | --- |' UNION ALL SELECT 'provenance', 2, kind, '| ' || kind || ' | ' || n || ' |' FROM n""",
    "context_contractors": """SELECT 0 AS part, '| ID | Company | Trade | Contact | Email | Phone | Sources |' AS line UNION ALL SELECT 0, '| --- | --- | --- | --- | --- | --- | --- |' UNION ALL SELECT 1, '| DL-' || s_suppkey || ' | ' || s_name || ' |  |  |  |  | [MASTER] |' FROM supplier""",
    "context_tenants": """SELECT 0 AS part, '| ID | Name | Unit | Owner | Start | End | Sources |' AS line UNION ALL SELECT 0, '| --- | --- | --- | --- | --- | --- | --- |'
 UNION ALL SELECT 1, '| MIE-' || c_custkey || ' | ' || c_name || ' |  |  |  | active | [MASTER] |' FROM customer""",
    "context_line_numbers": """WITH x AS (SELECT 'contractors' AS section_id, 0 AS k, '' AS id, '| ID | Company | Trade | Contact | Email | Phone | Sources |' AS line UNION ALL SELECT 'contractors', 1, '', '| --- | --- | --- | --- | --- | --- | --- |'
 UNION ALL SELECT 'contractors', 2, 'DL-' || s_suppkey, '| DL-' || s_suppkey || ' | ' || s_name || ' |  |  |  |  | [MASTER] |' FROM supplier
 UNION ALL SELECT 'tenants', 0, '', '| ID | Name | Unit | Owner | Start | End | Sources |' UNION ALL SELECT 'tenants', 1, '', '| --- | --- | --- | --- | --- | --- | --- |'
 UNION ALL SELECT 'tenants', 2, 'MIE-' || c_custkey, '| MIE-' || c_custkey || ' | ' || c_name || ' |  |  |  | active | [MASTER] |' FROM customer)
SELECT section_id, row_number() OVER (PARTITION BY section_id ORDER BY k, id) AS line_no, line FROM x""",
    "context_invoices": f"""WITH r AS (SELECT *, 'INV-DUP-' || o_orderkey AS i FROM orders WHERE o_orderkey % 11 = 0)
SELECT 0 AS part, unnest(['- Invoice facts: ' || (SELECT count(*) FROM orders), '- Amount available from structured index: ' || (SELECT count(*) FROM orders), '- Metadata-only PDF invoices pending text extraction: 0', '- Review/anomaly candidates: ' || (SELECT count(*) FROM r),
 '- Complete invoice ledger is in contexts/LIE-001/fact-index.json; Context.md shows review items and latest invoices only.', '', '### Review Candidates', '']) AS line
UNION ALL SELECT 2, '| ' || i || ' | ' || {DAY('o_orderdate')} || ' | DL-' || o_custkey || ' | ' || o_orderkey || ' | ' || CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) || ' | needs_review | [INDEX-BASE] |' FROM r""",
    "queue_members": f"WITH {QUEUE} SELECT kind, group_key, source_id FROM mem",
    "queue_items": f"""WITH {QUEUE}, h AS (SELECT DISTINCT kind, group_key, unnest(['DL-' || doc_id % 7, 'INV-' || doc_id % 50]) AS h FROM mem), hk AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY kind, group_key ORDER BY h) <= 12),
hh AS (SELECT kind, group_key, string_agg(h, ',' ORDER BY h) AS hints FROM hk GROUP BY 1, 2),
g AS (SELECT kind, group_key, count(*) AS n, CAST(sum(doc_id % 3) AS BIGINT) AS r, count(*) FILTER (WHERE doc_id % 13 = 0) AS f, bool_or(doc_id % 2 = 0) AS dated, min('DL-' || doc_id % 7) AS dl, min('typ' || doc_id % 4) AS typ FROM mem GROUP BY 1, 2),
p AS (SELECT *, CASE WHEN n = 1 THEN '' ELSE 's' END AS s, CASE WHEN r = 1 THEN '' ELSE 's' END AS rs FROM g JOIN hh USING (kind, group_key))
SELECT upper('WI-' || kind || '-' || replace(group_key, ':', '-')) AS work_item_id, kind, CASE kind WHEN 'letter_group' THEN 'pdf_letter_extractor' WHEN 'invoice_group' THEN 'invoice_bank_reconciler' WHEN 'bank_group' THEN 'invoice_bank_reconciler' ELSE 'structured_extractor' END AS processor, CAST(n AS BIGINT) AS sources,
 CASE kind WHEN 'invoice_group' THEN n || ' invoice source' || s || ' for ' || dl || '.' WHEN 'letter_group' THEN n || ' letter source' || s || ' grouped by ' || typ || '.' WHEN 'bank_group' THEN n || ' bank source' || s || ' with ' || r || ' parsed CSV row' || rs || '.'
 WHEN 'incremental_day' THEN 'day-01 daily drop with ' || n || ' new source' || s || '.' ELSE 'Canonical master data plus base index files for property identity, entity alignment, and starting ledger/document indexes.' END AS summary,
 CASE kind WHEN 'invoice_group' THEN 'invoice,pdf-metadata' WHEN 'letter_group' THEN 'letter,pdf-metadata' WHEN 'bank_group' THEN 'bank,ledger,reconciliation' WHEN 'incremental_day' THEN 'incremental,day-01' ELSE 'master-data,identity,indexes' END AS labels,
 CASE kind WHEN 'invoice_group' THEN 'flaggedFilenameCount=' || f || ',invoiceSourceCount=' || n WHEN 'letter_group' THEN 'letterSourceCount=' || n WHEN 'bank_group' THEN 'bankSourceCount=' || n || ',parsedRowCount=' || r WHEN 'incremental_day' THEN 'newSourceCount=' || n || ',parsedRowCount=' || r
 ELSE 'parsedRowCount=' || r || ',sourceFileCount=' || n END AS metrics, CASE WHEN dated THEN '2024-01-15..2024-01-15' END AS dates, hints FROM p""",
}
