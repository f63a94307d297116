"""SQL for the queries of this subpackage that SQL expresses over whole tables."""

P1 = r"""WITH RECURSIVE ties AS (SELECT DISTINCT upper(trim(conversation_id)) AS conv, upper(trim(contact_id)) AS ct FROM threads
  WHERE regexp_full_match(upper(trim(contact_id)), 'CT[0-9]{8}') AND trim(conversation_id) <> ''),
pairs AS (SELECT DISTINCT a.conv AS a, b.conv AS b FROM ties a JOIN ties b USING (ct) WHERE a.conv <> b.conv),
reach AS (SELECT DISTINCT conv AS a, conv AS b FROM ties UNION SELECT r.a, p.b FROM reach r JOIN pairs p ON r.b = p.a),
fam AS (SELECT a AS conv, min(b) AS family FROM reach GROUP BY a),
rows AS (SELECT upper(trim(conversation_id)) AS conv, CASE WHEN lower(trim(split)) IN ('val', 'validation') THEN 'dev' ELSE nullif(lower(trim(split)), '') END AS split FROM items WHERE trim(conversation_id) <> ''),
tied AS (SELECT conv, coalesce(family, conv) AS family, split FROM rows LEFT JOIN fam USING (conv)),
bad AS (SELECT family FROM tied GROUP BY family HAVING count(DISTINCT split) > 1)
SELECT DISTINCT conv AS conversation_id FROM tied WHERE family IN (SELECT family FROM bad)"""

ORACLES = {"p1_found": P1}
