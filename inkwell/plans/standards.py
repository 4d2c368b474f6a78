"""Queries on documents and standards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.operators import packs as P
from inkwell.operators import standards as S
from inkwell.operators import text as T
from inkwell.plans.metrics import LINES, docs
from inkwell.plans.packs import quoted, scan_sql
from inkwell.registry import query

_SCANS = " UNION ALL ".join(f"SELECT doc_id, {quoted(r.category)} AS standard, {quoted(r.rule_id)} AS rule_id, {quoted(r.severity)} AS severity, unnest(regexp_extract_all(t, {quoted(r.pattern)})) AS flagged FROM flat" for r in S.STANDARD_RULES)
_LACKS = " UNION ALL ".join(f"SELECT doc_id, {quoted(e.standard)}, {quoted(e.rule_id)}, {quoted(e.severity)}, '' FROM documents WHERE NOT ({' OR '.join(f'contains(lower(text), {quoted(t)})' for t in e.terms)})" for e in S.ELEMENTS)


@query("a34_standard_issues", rf"""WITH {LINES}, flat AS (SELECT doc_id, lower(regexp_replace(text, '[^\x01-\x7F]', '_', 'g')) AS t FROM lines), every AS ({_SCANS} UNION ALL {_LACKS})
SELECT doc_id, standard, rule_id, severity, count(*) AS issues, count(DISTINCT flagged) AS texts FROM every GROUP BY ALL""")
def standard_issues(spark: SparkSession, sf: str) -> DataFrame:
    texts = docs(spark, sf)
    return S.standard_issues(texts, T.paragraphs(texts)).groupBy("doc_id", "standard", "rule_id", "severity").agg(F.count("*").alias("issues"), F.countDistinct("flagged").alias("texts"))


_CLAUSES = ", ".join(f"({quoted(s)}, {quoted(k)}, {quoted(c)})" for s, of in S.CLAUSES.items() for k, c in of.items())


@query("a34_compliance_matrix", f"""WITH {LINES}, {scan_sql('lines')}, clauses(standard, key, clause) AS (VALUES {_CLAUSES})
SELECT doc_id, standard, clause, count(*) AS issues, (sum(count(*)) OVER (PARTITION BY doc_id, standard))::BIGINT AS of_standard FROM pack_hits JOIN clauses ON replace(category, ' ', '_') = key GROUP BY doc_id, standard, clause""")
def compliance_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return S.compliance_matrix(P.pack_scan(T.paragraphs(docs(spark, sf))))
