"""SQL for DuckDB: the carriers of sources.carrier as common table expressions, and a query over them."""

from __future__ import annotations

from strandwise.functions.dna import NIBBLES
from strandwise.sources.carrier import BASES, LETTERS, QUALS, READ

CARRIERS = f"""
letters AS (SELECT doc_id, regexp_replace(text, '[^A-Za-z]', '', 'g') t FROM documents),
mapped AS (SELECT doc_id, translate(t, '{LETTERS}', '{BASES}') b, translate(t, '{LETTERS}', '{QUALS}') q FROM letters WHERE length(t) > 0),
cut AS (SELECT doc_id, b, q, unnest(range(0, (length(b) - 1) // {READ} + 1)) k FROM mapped),
reads AS (SELECT doc_id * 1000000 + k AS ord, doc_id AS chunk, doc_id * 7 + k AS h, substr(b, k * {READ} + 1, {READ}) seq, substr(q, k * {READ} + 1, {READ}) qual FROM cut),
bases AS (SELECT ord, chunk, i - 1 AS pos, substr(seq, i, 1) base, ascii(substr(qual, i, 1))::BIGINT - 33 q FROM (SELECT *, unnest(range(1, length(seq) + 1)) i FROM reads)),
hdr AS (SELECT event_id AS ord, '@SIM:1:FC' || (user_id % 3) || ':' || (event_id % 4 + 1) || ':' || (1101 + event_id % 50) || ':' || ((event_id * 37) % 20000) || ':' || ((event_id * 53) % 30000) || ' 1:N:0:' || event_type AS header FROM events),
aln AS (SELECT ord, chunk, 'r' || (h // 2) AS name,
  (CASE WHEN h % 2 = 0 THEN 65 ELSE 129 END) + (CASE WHEN h % 3 = 0 THEN 16 ELSE 0 END) + (CASE WHEN h % 17 = 0 THEN 4 ELSE 0 END) + (CASE WHEN h % 29 = 0 THEN 256 ELSE 0 END) AS flag,
  CASE WHEN h % 17 = 0 THEN -1 ELSE h % 5 END AS ref_id,
  CASE WHEN h % 17 = 0 THEN -1 ELSE (h * 37) % 3000 + (CASE WHEN h % 11 = 0 THEN 200000 ELSE 0 END) END AS pos,
  h % 61 AS mapq, (h + h % 2) % 5 AS next_ref_id, (h * 53) % 3000 AS next_pos, h % 401 - 200 AS tlen,
  CASE WHEN h % 17 = 0 THEN [] WHEN h % 4 = 0 THEN [{{'op': 0, 'len': n}}] WHEN h % 4 = 1 THEN [{{'op': 4, 'len': 5}}, {{'op': 0, 'len': n - 5}}]
    WHEN h % 4 = 2 THEN [{{'op': 0, 'len': 5}}, {{'op': 1, 'len': 2}}, {{'op': 0, 'len': n - 7}}] ELSE [{{'op': 0, 'len': 8}}, {{'op': 2, 'len': 3}}, {{'op': 0, 'len': n - 8}}] END AS cigar,
  seq, qual FROM (SELECT *, length(seq)::BIGINT n FROM reads) WHERE n >= 30),
ops AS (SELECT ord, ref_id, pos, seq, unnest(range(1, len(cigar) + 1)) k, cigar FROM aln WHERE ref_id >= 0),
placed AS (SELECT ord, ref_id, seq, k, cigar[k].op op, cigar[k].len n,
  coalesce(sum(CASE WHEN cigar[k].op IN (0, 1, 4, 7, 8) THEN cigar[k].len ELSE 0 END) OVER (PARTITION BY ord ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT q0,
  (pos + coalesce(sum(CASE WHEN cigar[k].op IN (0, 2, 3, 7, 8) THEN cigar[k].len ELSE 0 END) OVER (PARTITION BY ord ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT r0 FROM ops),
steps AS (SELECT ord, ref_id, op, q0 + i query_pos, CASE WHEN op IN (0, 7, 8) THEN r0 + i END ref_pos, substr(seq, q0 + i + 1, 1) base,
  CASE WHEN instr('{NIBBLES}', substr(seq, q0 + i + 1, 1)) > 0 THEN instr('{NIBBLES}', substr(seq, q0 + i + 1, 1)) - 1 ELSE 15 END nibble
  FROM (SELECT *, unnest(range(0, n)) i FROM placed WHERE op IN (0, 1, 4, 7, 8)) WHERE substr(seq, q0 + i + 1, 1) <> ''),
votes AS (SELECT ref_id, ref_pos, nibble, n FROM (SELECT *, row_number() OVER (PARTITION BY ref_id, ref_pos ORDER BY n DESC, nibble) r FROM (SELECT ref_id, ref_pos, nibble, count(*) n FROM steps WHERE ref_pos IS NOT NULL AND nibble > 0 GROUP BY ALL)) WHERE r = 1)
"""

#: Reverse complement as a macro-free expression of DuckDB.
def rc(s: str) -> str:
    return f"reverse(translate(regexp_replace(upper({s}), '[^ACGT]', 'N', 'g'), 'ACGT', 'TGCA'))"


def kmers(k: int) -> str:
    """Table (ord, chunk, pos, x, kmer): k-mers without N, as they stand and canonical."""
    return f"(SELECT ord, chunk, pos, x, least(x, {rc('x')}) kmer FROM (SELECT ord, chunk, i - 1 AS pos, substr(seq, i, {k}) x FROM (SELECT *, unnest(range(1, length(seq) - {k} + 2)) i FROM reads)) WHERE x NOT LIKE '%N%')"


def minimizers(k: int, w: int) -> str:
    """Table (ord, chunk, place, m): minimizers with equal neighbours once."""
    return (
        f"(SELECT ord, chunk, place, m FROM (SELECT ord, chunk, place, m, lag(m) OVER (PARTITION BY ord ORDER BY place) p FROM "
        f"(SELECT ord, chunk, pos AS place, min(least(x, {rc('x')})) OVER (PARTITION BY ord ORDER BY pos ROWS BETWEEN CURRENT ROW AND {w - 1} FOLLOWING) m, n FROM "
        f"(SELECT ord, chunk, i - 1 AS pos, substr(seq, i, {k}) x, length(seq) n FROM (SELECT *, unnest(range(1, length(seq) - {k} + 2)) i FROM reads WHERE length(seq) >= {k + w}))) "
        f"WHERE place <= n - {k + w - 1}) WHERE p IS NULL OR p <> m)"
    )


def sql(body: str, more: str = "") -> str:
    return f"WITH {CARRIERS}{', ' + more if more else ''} {body}"
