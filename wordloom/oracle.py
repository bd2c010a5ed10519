"""DuckDB SQL for the registered queries, written independently of the operators."""

from __future__ import annotations

from wordloom.functions.text import ABBREVIATIONS, INVENTED, TERMINAL
from wordloom.params import KNOBS, STAGE_OF
from wordloom.queries import NOW


def _list(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


# Words with times, and the score of the boundary after each. \s doesn't hold the no-break space here.
WORDS = rf"""
l AS (
  SELECT doc_id AS job_id, list_filter(string_split_regex(text, '[ \t\n]+'), lambda x: x <> '') AS l FROM documents
), u AS (
  SELECT job_id, unnest(l) AS text, unnest(range(0, len(l)))::INT AS word_index FROM l
), g AS (
  SELECT *, 80 + 40 * length(text) AS dur, (job_id * 7919 + word_index * 104729) % 1000 AS h FROM u
), t AS (
  SELECT *, coalesce(sum(dur + CASE WHEN h < 5 THEN 2500 WHEN h < 20 THEN 900 WHEN h < 30 THEN -40 ELSE 20 + h % 200 END)
    OVER (PARTITION BY job_id ORDER BY word_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS ms FROM g
), w AS (
  SELECT job_id, word_index, text, ms / 1000.0::DOUBLE AS "start", (ms + dur) / 1000.0::DOUBLE AS "end" FROM t
), b AS (
  SELECT *, regexp_replace(regexp_replace(text, '["'')\]}}»”’]+$', ''), '[\s\x{{00A0}}]+$', '') AS bare FROM w
), k AS (
  SELECT *, regexp_extract(regexp_replace(bare, '\.$', ''), '([^\s\x{{00A0}}]+)[\s\x{{00A0}}]*$', 1) AS token FROM b
), m AS (
  SELECT *, right(bare, 1) IN ({_list(TERMINAL)}) AND NOT (right(bare, 1) = '.' AND
    (regexp_replace(lower(token), '^[(\[{{]+|[(\[{{]+$', '', 'g') IN ({_list(ABBREVIATIONS)}) OR regexp_matches(token, '^\p{{L}}$'))) AS mark,
    lead("start") OVER (PARTITION BY job_id ORDER BY word_index) AS after FROM k
), c AS (
  SELECT job_id, word_index, text, "start", "end", after, mark AS has_terminal_punct,
    CASE WHEN after IS NULL THEN 1.0::DOUBLE ELSE least(1.0::DOUBLE, 1.0::DOUBLE - (1.0::DOUBLE - 0.0::DOUBLE)
      * (1.0::DOUBLE - CASE WHEN mark THEN 0.95::DOUBLE ELSE 0.0::DOUBLE END)
      * (1.0::DOUBLE - 0.35::DOUBLE * least(1.0::DOUBLE, (after - "end") / 0.5::DOUBLE))) END AS score,
    CASE WHEN after IS NULL THEN 0.0::DOUBLE ELSE after - "end" END AS pause_after,
    CASE WHEN after IS NULL THEN 'eof' WHEN mark THEN 'punctuation' ELSE 'fused' END AS source FROM m
)"""
SEGMENTS = WORDS + """, s AS (
  SELECT *, score >= 0.5::DOUBLE OR after IS NULL OR after - "end" >= 2.0::DOUBLE AS split FROM c
), n AS (
  SELECT *, coalesce(sum(split::INT) OVER (PARTITION BY job_id ORDER BY word_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS seg_index FROM s
), sg AS (
  SELECT job_id, seg_index, min(word_index) AS word_start, (max(word_index) + 1)::INT AS word_end, string_agg(text, ' ' ORDER BY word_index) AS text,
    arg_min("start", word_index) AS "start", arg_max("end", word_index) AS "end", arg_max(score, word_index) AS score, arg_max(source, word_index) AS source,
    arg_min("end" - "start", word_index) AS first_seconds, arg_max("end" - "start", word_index) AS last_seconds FROM n GROUP BY job_id, seg_index
), seg AS (
  SELECT *, CASE WHEN word_end - word_start < 2 AND "end" - "start" < 1.2::DOUBLE THEN 'skip' ELSE 'speech' END AS kind FROM sg
)"""
CUTS = SEGMENTS + """, nx AS (
  SELECT *, lead("start") OVER j AS ns, lead(first_seconds) OVER j AS nd, max("end") OVER (PARTITION BY job_id) + 3.0 AS media_end
  FROM seg WINDOW j AS (PARTITION BY job_id ORDER BY seg_index)
), rg AS (
  SELECT *, CASE WHEN ns IS NULL THEN 'last' WHEN ns - "end" >= 0.15::DOUBLE + 0.10::DOUBLE + 0.10::DOUBLE THEN 'trim'
    WHEN ns + least(0.08::DOUBLE, nd * 0.5::DOUBLE) <= "end" - least(0.08::DOUBLE, last_seconds * 0.5::DOUBLE) THEN 'edge' ELSE 'seam' END AS regime FROM nx
), lr AS (
  SELECT *, CASE regime WHEN 'last' THEN least(media_end, "end" + 0.15::DOUBLE) WHEN 'trim' THEN "end" + 0.15::DOUBLE WHEN 'edge' THEN greatest(0, "end")
      ELSE greatest(0, ("end" + ns) / 2) END AS o,
    CASE regime WHEN 'trim' THEN ns - 0.10::DOUBLE WHEN 'edge' THEN greatest(0, "end") WHEN 'seam' THEN greatest(0, ("end" + ns) / 2) END AS ni FROM rg
), ct AS (
  SELECT *, coalesce(lag(ni) OVER j, greatest(0, "start" - 0.10::DOUBLE)) AS src_in, coalesce(lag(regime = 'edge') OVER j, false) AS hard_in, regime = 'edge' AS hard_out
  FROM lr WINDOW j AS (PARTITION BY job_id ORDER BY seg_index)
), cut AS (
  SELECT * EXCLUDE (o), greatest(o, src_in) AS src_out, kind = 'speech' AND seg_index % 5 <> 4 AS spoken FROM ct
)"""
CLIPS = CUTS + """, pv AS (
  SELECT *, lag(src_out) OVER (PARTITION BY job_id ORDER BY seg_index) AS po FROM cut
), cl AS (
  SELECT job_id, seg_index, 0 AS part, 'source' AS kind, src_in - coalesce(po, 0) AS duration, coalesce(po, 0.0::DOUBLE) AS src_start, src_in AS src_end,
    NULL AS path, CASE WHEN po IS NULL THEN 0.0 ELSE 0.01 END::DOUBLE AS fade_in, 0.01::DOUBLE AS fade_out, NULL AS label FROM pv WHERE src_in - coalesce(po, 0) > 1.5
  UNION ALL SELECT job_id, seg_index, 1, 'source', src_out - src_in, src_in, src_out, NULL, CASE WHEN hard_in THEN 0.025 ELSE 0.01 END, CASE WHEN hard_out THEN 0.025 ELSE 0.01 END, NULL FROM pv
  UNION ALL SELECT job_id, seg_index, 2, 'silence', 0.25, NULL, NULL, NULL, 0, 0, NULL FROM pv WHERE spoken
  UNION ALL SELECT job_id, seg_index, 3, 'tts', length(text) * 0.0625, NULL, NULL, 'tts/' || job_id || '-' || seg_index || '.wav', 0.01, 0.01, 'T:' || text FROM pv WHERE spoken
  UNION ALL SELECT job_id, seg_index, 4, 'silence', 0.35, NULL, NULL, NULL, 0, 0, NULL FROM pv WHERE spoken
  UNION ALL SELECT job_id, seg_index, 5, 'source', media_end - src_out, src_out, media_end, NULL, 0.01, 0, NULL FROM pv WHERE ns IS NULL AND media_end - src_out > 0.05
), clip AS (
  SELECT *, (row_number() OVER (PARTITION BY job_id ORDER BY seg_index, part) - 1)::INT AS clip_index,
    coalesce(sum(duration) OVER (PARTITION BY job_id ORDER BY seg_index, part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE) AS out_start
  FROM cl WHERE duration > 0
)"""
# Sentence ranges, short ones merged, long ones divided; limits are filled in.
RANGES = """wp AS (
  SELECT *, coalesce(after - "end", 0.0::DOUBLE) AS pause, lead("start") OVER (PARTITION BY job_id ORDER BY word_index) AS next_start FROM c
)"""
SPLITS = """cp AS (
  SELECT job_id, word_index + 1 AS cut FROM wp WHERE score >= 0.5::DOUBLE OR after IS NULL OR after - "end" >= 2.0::DOUBLE
)"""
# Words by count: each cut goes to the longest pause near the next ideal place.
COUNTED = """pl AS (
  SELECT job_id, list(pause ORDER BY word_index) AS p, count(*) AS n FROM wp GROUP BY job_id
), ck(job_id, pos, n) AS (
  SELECT job_id, 0::BIGINT, n FROM pl
  UNION ALL
  SELECT job_id, CASE WHEN low > high THEN ideal + 1 ELSE low + list_position(p[low + 1:high + 1], list_max(p[low + 1:high + 1])) END, n FROM (
    SELECT ck.job_id, ck.n, p, pos + 11 AS ideal, greatest(pos, pos + 7) AS low, least(ck.n - 2, pos + 15) AS high FROM ck JOIN pl USING (job_id) WHERE pos + 12 < ck.n)
), cp AS (
  SELECT job_id, pos AS cut FROM ck WHERE pos > 0 UNION SELECT job_id, word_index + 1 FROM wp WHERE after IS NULL OR after - "end" >= 2.0::DOUBLE
)"""
# One range after another: what a short range has absorbed counts when it is judged next.
MERGED = """cu AS (
  SELECT cp.job_id, cut, row_number() OVER (PARTITION BY cp.job_id ORDER BY cut) AS i, count(*) OVER (PARTITION BY cp.job_id) AS m,
         "end" AS stop, next_start, score < 0.8::DOUBLE AND pause < 2.0::DOUBLE AS weak FROM cp JOIN wp ON wp.job_id = cp.job_id AND word_index = cut - 1
), mg(job_id, i, a, b, a_start, stop, next_start, weak_before, weak, kept) AS (
  SELECT cu.job_id, 0::BIGINT, 0::BIGINT, 0::BIGINT, "start", "start", "start", false, false, true FROM cu JOIN wp ON wp.job_id = cu.job_id AND word_index = 0 WHERE i = 1
  UNION ALL
  SELECT job_id, i, a, b, a_start, stop, next_start, weak_before, weak, NOT (i < m AND weak AND (b - a < {min_words} OR stop - a_start < {min_duration}::DOUBLE)) FROM (
    SELECT cu.job_id, cu.i, cu.m, CASE WHEN kept THEN mg.b ELSE a END AS a, cu.cut AS b, CASE WHEN kept THEN mg.next_start ELSE a_start END AS a_start,
           cu.stop, cu.next_start, CASE WHEN kept THEN mg.weak ELSE weak_before END AS weak_before, cu.weak
    FROM mg JOIN cu ON cu.job_id = mg.job_id AND cu.i = mg.i + 1)
), kp AS (
  SELECT *, lead(b) OVER j AS nb, lead(weak_before AND (b - a < {min_words} OR stop - a_start < {min_duration}::DOUBLE)) OVER j AS next_joins,
         lead(b, 2) OVER j AS after_next FROM mg WHERE kept AND i > 0 WINDOW j AS (PARTITION BY job_id ORDER BY i)
), rg AS (
  SELECT job_id, coalesce(lag(b) OVER (PARTITION BY job_id ORDER BY b), 0)::BIGINT AS a, b FROM kp WHERE NOT (nb IS NOT NULL AND after_next IS NULL AND next_joins)
)"""
# Each range with its words as lists; too long ones are cut after the best score, then the longest pause, the first of ties.
DIVIDED = """rl AS (
  SELECT rg.job_id, a, list("start" ORDER BY word_index) AS s, list("end" ORDER BY word_index) AS e, list(score ORDER BY word_index) AS k, list(pause ORDER BY word_index) AS p
  FROM rg JOIN wp ON wp.job_id = rg.job_id AND word_index >= a AND word_index < b GROUP BY rg.job_id, a
), dv(job_id, a, s, e, k, p, cut) AS (
  SELECT job_id, a, s, e, k, p, {cut} FROM rl
  UNION ALL
  SELECT job_id, a, s, e, k, p, {cut} FROM (
    SELECT job_id, CASE WHEN side THEN a ELSE a + cut END AS a, CASE WHEN side THEN s[:cut] ELSE s[cut + 1:] END AS s, CASE WHEN side THEN e[:cut] ELSE e[cut + 1:] END AS e,
           CASE WHEN side THEN k[:cut] ELSE k[cut + 1:] END AS k, CASE WHEN side THEN p[:cut] ELSE p[cut + 1:] END AS p
    FROM dv, (VALUES (true), (false)) v(side) WHERE cut IS NOT NULL)
), fr AS (
  SELECT job_id, a, a + len(s) AS b FROM dv WHERE cut IS NULL
)"""
_CUT = """CASE WHEN (e[len(e)] - s[1] > {max_duration}::DOUBLE OR len(s) > {max_words}) AND len(s) >= 2 * {min_words} THEN
    -list_max(list_transform(range({min_words}, len(s) - {min_words} + 1), lambda i: struct_pack(x := k[i], y := p[i], z := -i))).z END"""
FOLDED = """nr AS (
  SELECT *, (row_number() OVER (PARTITION BY job_id ORDER BY a) - 1)::INT AS seg_index FROM {ranges}
), fs AS (
  SELECT nr.job_id, seg_index, a::INT AS word_start, b::INT AS word_end, string_agg(text, ' ' ORDER BY word_index) AS text, arg_min("start", word_index) AS "start",
    arg_max("end", word_index) AS "end", arg_max(score, word_index) AS score, arg_max(source, word_index) AS source
  FROM nr JOIN c ON c.job_id = nr.job_id AND word_index >= a AND word_index < b GROUP BY nr.job_id, seg_index, a, b
) SELECT job_id, seg_index, word_start, word_end, text, "start", "end", CASE WHEN word_end - word_start < {min_words} AND "end" - "start" < {min_duration}::DOUBLE THEN 'skip' ELSE 'speech' END AS kind,
    score, source FROM fs"""


def _folded(cuts: str, merge: bool = True, divide: bool = True) -> str:
    limits = {"min_words": 2 if merge else 1, "min_duration": 1.2 if merge else 0.0}
    cut = _CUT.format(max_duration=15.0, max_words=40, **limits)
    steps = [WORDS, RANGES, cuts, MERGED.format(**limits), *([DIVIDED.format(cut=cut)] if divide else [])]
    return "WITH RECURSIVE " + ", ".join(steps) + ", " + FOLDED.format(ranges="fr" if divide else "rg", **limits)


# Runs one after another: a text is compared with the last two that stayed.
REPEATS = """rw AS (
  SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY run) AS i FROM runs
), fo(job_id, i, run, text, kept, one, two) AS (
  SELECT DISTINCT job_id, 0::BIGINT, NULL::INT, NULL::VARCHAR, false, NULL::VARCHAR, NULL::VARCHAR FROM rw
  UNION ALL
  SELECT job_id, i, run, text, kept, CASE WHEN kept THEN text ELSE one END, CASE WHEN kept THEN one ELSE two END FROM (
    SELECT rw.job_id, rw.i, rw.run, rw.text, one, two, rw.text <> '' AND NOT bad AND rw.text IS DISTINCT FROM one AND rw.text IS DISTINCT FROM two AS kept
    FROM fo JOIN rw ON rw.job_id = fo.job_id AND rw.i = fo.i + 1)
)"""
# Words some of whose times are missing. A start is that of the word, or the end before it; ends never precede starts.
UNTIMED = """uw AS (
  SELECT job_id, word_index, text, CASE WHEN (job_id * 31 + word_index * 17) % 23 = 0 THEN NULL ELSE "start" END AS s,
    CASE WHEN (job_id * 13 + word_index * 7) % 11 = 0 THEN NULL ELSE "end" END AS e FROM w
), st AS (
  SELECT *, count(s) OVER (PARTITION BY job_id ORDER BY word_index) AS g FROM uw
), en AS (
  SELECT *, max(CASE WHEN s IS NULL THEN e ELSE greatest(coalesce(e, s), s) END) OVER (PARTITION BY job_id, g ORDER BY word_index) AS top FROM st
), fl AS (
  SELECT job_id, word_index, text, s, CASE WHEN g = 0 THEN greatest(coalesce(top, 0), 0.0::DOUBLE) ELSE top END AS e FROM en
), ru AS (
  SELECT *, lag(e) OVER (PARTITION BY job_id ORDER BY word_index) AS before FROM fl
), rn AS (
  SELECT job_id, word_index, text, coalesce(s, before, 0.0::DOUBLE) AS "start", e AS "end",
    sum(coalesce((coalesce(s, before, 0.0::DOUBLE) - before > 0.8::DOUBLE)::INT, 0)) OVER (PARTITION BY job_id ORDER BY word_index)::INT AS run FROM ru
)"""
TURNS = """
t AS (
  SELECT conv_id AS job_id, turn::INT AS seg_index, text, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INT AS r FROM conversations
  WHERE trim(text) <> ''
)"""
KEYS = "k AS (SELECT conv_id AS job_id, turn::INT AS seg_index, substr(sha256('en' || chr(0) || 'af_heart' || chr(0) || text), 1, 16) AS text_sha FROM conversations WHERE text <> '')"
JOBS = f"""
j AS (
  SELECT o_orderkey::VARCHAR AS id, o_orderkey AS n, epoch(o_orderdate)::DOUBLE AS t, o_orderstatus = 'F' AND o_orderkey % 7 = 0 AS again, o_orderstatus AS s FROM orders
), q AS (
  SELECT id, n, t AS created_at, CASE WHEN again OR s = 'O' THEN 'queued' WHEN s = 'P' THEN 'running' WHEN n % 3 = 0 THEN 'failed' ELSE 'done' END AS status,
    CASE WHEN s <> 'O' AND NOT again THEN 'asr' END AS stage,
    CASE WHEN again OR s = 'O' THEN 0.0 WHEN s = 'P' THEN least(1.0, (n % 13) / 10.0) WHEN n % 3 = 0 THEN 0.0 ELSE 1.0 END::DOUBLE AS progress,
    CASE WHEN s = 'F' AND NOT again AND n % 3 = 0 THEN 'broken' END AS error, CASE WHEN s = 'F' THEN n % 4 ELSE 0 END::INT AS warnings,
    CASE WHEN s <> 'O' AND NOT again THEN t + 10 END AS started_at, CASE WHEN s = 'F' AND NOT again THEN t + 2000 END AS finished_at,
    CASE WHEN s <> 'O' AND NOT again THEN t + n % 1000 END AS heartbeat_at FROM j
)"""

_CHANGED = {s: " OR ".join(f"p_partkey % {i + 7} = 0" for i, k in enumerate(KNOBS) if STAGE_OF.get(k) == s) for s in ("segment", "translate", "tts")}
_FOUND = " OR ".join(f"regexp_matches(text, '(?i){p}')" for p in INVENTED)
_FRAMES = """f AS (
  SELECT vec_id, i AS frame, sqrt(list_sum(list_transform(embedding[i * 4 + 1:i * 4 + 8], lambda x: x::DOUBLE * x::DOUBLE)) / 8)::FLOAT AS level
  FROM embeddings, range(0, 15) r(i)
)"""
# Frames of 2 samples and hops of 1 at 200 Hz; the quietest, nearest to a centre in seconds from the first sample.
_FINE = """ff AS (
  SELECT {keys}, k, CASE WHEN {length} < 2 THEN {length} / 400.0::DOUBLE ELSE (k + 1.0::DOUBLE) / 200 END AS sec, {centre} AS c,
    sqrt(list_sum(list_transform({samples}[k + 1:k + 2], lambda v: v::DOUBLE * v::DOUBLE)) / len({samples}[k + 1:k + 2]))::FLOAT AS level
  FROM {source}, range(0, 1000) r(k) WHERE len({samples}) > 0 AND (k + 2 <= {length} OR k = 0)
), fl AS (
  SELECT *, min(level) OVER (PARTITION BY {keys}) AS least FROM ff
), q AS (
  SELECT {keys}, arg_min(sec, struct_pack(a := abs(sec - c), b := k)) AS sec, arg_min(level, struct_pack(a := abs(sec - c), b := k)) AS level FROM fl
  WHERE level <= (least::DOUBLE + greatest(0.2::DOUBLE * least::DOUBLE, 0.00001::DOUBLE))::FLOAT GROUP BY {keys}
)"""
# Sound of 16 embeddings a job, and spans of it clamped to it.
_SPANS = """au AS (
  SELECT vec_id // 16 AS job_id, flatten(list(e ORDER BY vec_id)) AS s FROM (SELECT vec_id, embedding AS e FROM embeddings) GROUP BY vec_id // 16
), sp AS (
  SELECT job_id, s, k::INT AS span, k * {step}::DOUBLE - 0.05::DOUBLE AS l0, k * {step}::DOUBLE - 0.05::DOUBLE + (k % 4 + 1) * {length}::DOUBLE AS h0 FROM au, range(0, {n}) r(k)
), cl AS (
  SELECT *, greatest(0.0::DOUBLE, l0) AS low, least(len(s) / 200.0::DOUBLE, h0) AS high FROM sp
), cut AS (
  SELECT *, CASE WHEN trunc(high * 200) > trunc(low * 200) THEN s[(trunc(low * 200) + 1)::BIGINT:trunc(high * 200)::BIGINT] ELSE [] END AS x FROM cl
)"""
_LINES = r"l AS (SELECT doc_id AS job_id, unnest(string_split(text, chr(10))) AS text FROM documents)"

ORACLE = {
    "sentences": f'WITH {SEGMENTS} SELECT job_id, seg_index, word_start, word_end, text, "start", "end", kind, score, source FROM seg',
    "boundary_scores": f"WITH {WORDS} SELECT job_id, word_index, score, pause_after, has_terminal_punct, source FROM c",
    "ambiguous_boundaries": f"WITH {WORDS} SELECT job_id, word_index, score FROM c WHERE score >= 0.35::DOUBLE AND score < 0.65::DOUBLE AND source <> 'eof'",
    "arbiter_windows": f"""WITH {WORDS}, a AS (SELECT job_id, word_index, (row_number() OVER (PARTITION BY job_id ORDER BY word_index) - 1) // 25 AS batch
        FROM c WHERE score >= 0.35::DOUBLE AND score < 0.65::DOUBLE AND source <> 'eof')
        SELECT job_id, batch::INT AS batch, count(*)::INT AS asked, min(word_index) AS first, greatest(0, min(word_index) - 20)::INT AS low,
        (max(word_index) + 21)::INT AS high FROM a GROUP BY job_id, batch""",
    "arbitrated_scores": f"""WITH {WORDS}, a AS (SELECT *, score >= 0.35::DOUBLE AND score < 0.65::DOUBLE AND source <> 'eof' AS gray FROM c)
        SELECT job_id, word_index, CASE WHEN NOT gray THEN score WHEN word_index % 2 = 0 THEN greatest(score, 0.6::DOUBLE) ELSE least(score, 0.4::DOUBLE) END AS score,
        CASE WHEN gray THEN 'llm' ELSE source END AS source FROM a""",
    "arbitration": f"""WITH {WORDS}, ga AS (SELECT *, score >= 0.35::DOUBLE AND score < 0.65::DOUBLE AND source <> 'eof' AS gray FROM c),
        gb AS (SELECT *, CASE WHEN gray THEN (sum(gray::INT) OVER (PARTITION BY job_id ORDER BY word_index) - 1) // 25 END AS batch FROM ga),
        gn AS (SELECT *, count(*) OVER (PARTITION BY job_id, batch) AS asked, min(word_index) OVER (PARTITION BY job_id, batch) AS first FROM gb)
        SELECT job_id, word_index, CASE WHEN NOT gray THEN score WHEN asked > 20 OR asked > 1 AND (word_index % 2 = 0 OR word_index = first + 1)
          THEN greatest(score, 0.6::DOUBLE) ELSE least(score, 0.4::DOUBLE) END AS score, CASE WHEN gray THEN 'llm' ELSE source END AS source FROM gn""",
    "speech_runs": f"""WITH {WORDS}, {UNTIMED} SELECT job_id, run, string_agg(text, ' ' ORDER BY word_index) AS text, count(*) AS n_words,
        min("start") AS "start", max("end") AS "end" FROM rn GROUP BY job_id, run""",
    "constrained_segments": _folded(SPLITS),
    "merged_segments": _folded(SPLITS, divide=False),
    "divided_segments": _folded(SPLITS, merge=False),
    "word_chunks": _folded(COUNTED),
    "kept_lines": f"""WITH RECURSIVE l AS (SELECT doc_id AS job_id, unnest(string_split(text, chr(10))) AS text, unnest(range(0, len(string_split(text, chr(10)))))::INT AS run FROM documents),
        runs AS (SELECT job_id, run, regexp_replace(text, '^[\\s\\x{{A0}}]+|[\\s\\x{{A0}}]+$', '', 'g') AS text, {_FOUND} AS bad FROM l), {REPEATS}
        SELECT job_id, run, text, kept FROM fo WHERE i > 0""",
    "collected_words": f"""WITH RECURSIVE {WORDS}, {UNTIMED}, runs AS (SELECT job_id, run, string_agg(text, ' ' ORDER BY word_index) AS text, false AS bad FROM rn GROUP BY job_id, run),
        rx AS (SELECT job_id, run, text, {_FOUND} AS bad FROM runs), {REPEATS.replace('FROM runs', 'FROM rx')}
        SELECT rn.job_id, (row_number() OVER (PARTITION BY rn.job_id ORDER BY "start", "end", word_index) - 1)::INT AS word_index, rn.text, "start", "end"
        FROM rn JOIN fo ON fo.job_id = rn.job_id AND fo.run = rn.run AND kept""",
    "invented_lines": f"WITH {_LINES} SELECT job_id, count(*) FILTER ({_FOUND}) AS invented, count(*) AS n FROM l GROUP BY job_id",
    "job_summary": f"WITH {SEGMENTS} SELECT job_id, count(*) AS segments, count(*) FILTER (kind = 'speech') AS speech, 0::BIGINT AS warnings FROM seg GROUP BY job_id",
    "preview_excerpt": f"""WITH {SEGMENTS}, r AS (SELECT job_id, seg_index, row_number() OVER (PARTITION BY job_id ORDER BY seg_index) - 1 AS rank,
        count(*) OVER (PARTITION BY job_id) AS n FROM seg WHERE kind = 'speech') SELECT job_id, seg_index FROM r WHERE abs(rank - least(5, n - 1)) <= 1""",
    "word_marks": rf"""WITH {WORDS} SELECT DISTINCT text, has_terminal_punct AS ends, regexp_replace(text, '[^\p{{L}}\p{{N}} _-]', '', 'g') AS safe,
        CASE WHEN length(text) > 8 THEN left(text, 8) || '…' ELSE text END AS short FROM c""",
    "translation_prompts": f"""WITH {TURNS}, b AS (SELECT *, r // 3 AS batch, r % 3 AS place FROM t), p AS (
        SELECT job_id, batch, count(*)::INT AS n, string_agg(place || '. ' || text, chr(10) ORDER BY place) AS body FROM b GROUP BY job_id, batch), x AS (
        SELECT p.job_id, p.batch, string_agg('- ' || t.text, chr(10) ORDER BY t.r) AS ctx FROM p JOIN t ON t.job_id = p.job_id AND t.r >= p.batch * 3 - 2 AND t.r < p.batch * 3 GROUP BY ALL)
        SELECT job_id, batch::INT AS batch, n, CASE WHEN ctx IS NULL THEN '' ELSE 'Preceding context (do not translate):' || chr(10) || ctx || chr(10) || chr(10) END
        || 'Translate these ' || n || ' sentences into English:' || chr(10) || body AS prompt FROM p LEFT JOIN x USING (job_id, batch)""",
    "checked_replies": f"WITH {TURNS} SELECT job_id, (r // 3)::INT AS batch, (r % 3)::INT AS place, trim('EN:' || text, ' ' || chr(9) || chr(10) || chr(13)) AS translation FROM t WHERE job_id % 3 <> 0",
    "translated_turns": f"""WITH {TURNS}, n AS (SELECT *, count(*) OVER (PARTITION BY job_id, r // 3) AS n FROM t), a AS (
        SELECT job_id, seg_index, text, n = 3 OR length(text) % 2 = 0 AS told FROM n)
        SELECT c.conv_id AS job_id, c.turn::INT AS seg_index, CASE WHEN told THEN regexp_replace('EN:' || a.text, '\\s+$', '') ELSE a.text END AS translation,
        coalesce(NOT told, false) AS translation_failed FROM conversations c LEFT JOIN a ON a.job_id = c.conv_id AND a.seg_index = c.turn""",
    "voiced_turns": f"""WITH {KEYS}, h AS (SELECT DISTINCT text_sha FROM k WHERE job_id % 2 = 0)
        SELECT conv_id AS job_id, turn::INT AS seg_index, CASE WHEN h.text_sha IS NOT NULL OR length(text) >= 40 THEN 'tts/' || k.text_sha || '.wav' END AS tts_path,
        CASE WHEN h.text_sha IS NOT NULL THEN 1.0 WHEN length(text) >= 40 THEN length(text) / 16.0 END::DOUBLE AS tts_duration
        FROM conversations c LEFT JOIN k ON k.job_id = c.conv_id AND k.seg_index = c.turn LEFT JOIN h USING (text_sha)""",
    "detected_probabilities": f"""WITH {WORDS}, x AS (SELECT job_id, word_index, sum(length(text) + 1) OVER (PARTITION BY job_id ORDER BY word_index) - 2 AS last FROM w)
        SELECT job_id, word_index, ((last * 7) % 100)::INT / 100.0::DOUBLE AS probability FROM x""",
    "clip_keys": f"WITH {KEYS} SELECT * FROM k",
    "cache_misses": f"WITH {KEYS} SELECT DISTINCT text_sha, 'af_heart' AS voice, 'en' AS lang FROM k WHERE text_sha NOT IN (SELECT text_sha FROM k WHERE job_id % 2 = 0)",
    "cache_unused": f"""WITH {KEYS} SELECT DISTINCT 'tts/' || text_sha || '.wav' AS path FROM k WHERE job_id % 2 = 0
        AND text_sha NOT IN (SELECT text_sha FROM k WHERE job_id % 4 = 0)""",
    "queue_stats": f"WITH {JOBS} SELECT status, count(*) AS n FROM q GROUP BY status",
    "queue_public": f"""WITH {JOBS} SELECT id, status, stage, round_even(progress, 3) AS progress, error, warnings,
        CASE WHEN started_at IS NULL THEN 0.0 ELSE round_even(coalesce(finished_at, {NOW}) - started_at, 1) END::DOUBLE AS elapsed, status IN ('done', 'failed') AS is_terminal FROM q""",
    "queue_recent": f"WITH {JOBS} SELECT id, status, created_at FROM q ORDER BY created_at DESC, id LIMIT 25",
    "queue_next": f"WITH {JOBS} SELECT id, created_at FROM q WHERE status = 'queued' ORDER BY created_at, id LIMIT 1",
    "queue_stale": f"WITH {JOBS} SELECT id FROM q WHERE status = 'running' AND coalesce(heartbeat_at, 0) < {NOW} - 180",
    "queue_expired": f"WITH {JOBS} SELECT id FROM q WHERE status IN ('done', 'failed') AND created_at < {NOW} - 1000 * 86400",
    "queue_cancellations": f"WITH {JOBS} SELECT id, CASE status WHEN 'queued' THEN 'finished' WHEN 'running' THEN 'cancel' END AS kind, status IN ('queued', 'running') AS accepted FROM q",
    "invalidated_stages": "SELECT p_partkey, CASE " + " ".join(f"WHEN {c} THEN '{s}'" for s, c in _CHANGED.items()) + " END AS stage FROM part",
    "segment_cuts": f"WITH {CUTS} SELECT job_id, seg_index, round(src_in, 6) AS src_in, round(src_out, 6) AS src_out, hard_in, hard_out FROM cut",
    "edit_list": f"""WITH {CLIPS} SELECT job_id, clip_index, kind, round(out_start, 6) AS out_start, round(duration, 6) AS duration,
        round(src_start, 6) AS src_start, round(src_end, 6) AS src_end, path, fade_in, fade_out FROM clip""",
    "plan_stats": f"""WITH {CLIPS} SELECT job_id, source_duration, output_duration, translated_segments, n - translated_segments AS skipped_segments, hard_splices FROM
        (SELECT job_id, round(max(media_end), 6) AS source_duration, count(*) AS n, count(*) FILTER (hard_out) AS hard_splices FROM cut GROUP BY job_id) JOIN
        (SELECT job_id, round(sum(duration), 6) AS output_duration, count(*) FILTER (kind = 'tts') AS translated_segments FROM clip GROUP BY job_id) USING (job_id)""",
    "plan_violations": f"""WITH {CLIPS}, fa(k, problem) AS (VALUES (0, 'not contiguous'), (1, 'negative duration'), (2, 'no source range'), (3, 'inverted source range'),
        (4, 'duration differs from source range'), (5, 'no path'), (6, 'not anchored')), ft AS (SELECT job_id, min(clip_index) FILTER (kind = 'tts') AS voice FROM clip GROUP BY job_id)
        SELECT job_id, clip_index, problem FROM clip JOIN ft USING (job_id) JOIN fa ON k = job_id % 8
        WHERE clip_index = CASE WHEN k < 2 THEN 1 WHEN k = 5 THEN voice ELSE 0 END""",
    "excerpt_list": f"""WITH {CLIPS}, r AS (SELECT job_id, seg_index, row_number() OVER (PARTITION BY job_id ORDER BY seg_index) - 1 AS rank,
        count(*) OVER (PARTITION BY job_id) AS total FROM cut WHERE kind = 'speech'), ex AS (SELECT cl.* FROM cl JOIN r USING (job_id, seg_index)
          WHERE abs(rank - least(3, total - 1)) <= 1 AND part < 5 AND duration > 0)
        SELECT job_id, (row_number() OVER j - 1)::INT AS clip_index, kind, round(coalesce(sum(duration) OVER (j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE), 6) AS out_start,
          round(duration, 6) AS duration, round(src_start, 6) AS src_start, fade_in FROM ex WINDOW j AS (PARTITION BY job_id ORDER BY seg_index, part)""",
    "freeze_times": f"""WITH {CLIPS} SELECT job_id, clip_index, round(CASE WHEN kind <> 'source' THEN coalesce(last_value(CASE WHEN kind = 'source' THEN src_end END IGNORE NULLS)
        OVER (PARTITION BY job_id ORDER BY clip_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) END, 6) AS freeze_at FROM clip""",
    "sample_places": f"""WITH {CLIPS}, x AS (SELECT job_id, clip_index, round_even(round(duration, 6) * 24000, 0)::BIGINT AS n_samples FROM clip)
        SELECT *, coalesce(sum(n_samples) OVER (PARTITION BY job_id ORDER BY clip_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first_sample FROM x""",
    "lyric_lines": f"""WITH {CLIPS}, x AS (SELECT job_id, clip_index, label, round(out_start, 4) AS a FROM clip WHERE kind = 'tts')
        SELECT job_id, clip_index, printf('[%02d:%05.2f]', floor(a / 60)::INT, round((a - floor(a / 60) * 60)::VARCHAR::DECIMAL(30, 18), 2)::DOUBLE) || replace(label, chr(10), ' ') AS line FROM x""",
    "signal_levels": f"WITH {_FRAMES} SELECT vec_id, frame::INT AS frame, round(level::DOUBLE, 5) AS level FROM f",
    "signal_peaks": "SELECT vec_id, list_max(list_transform(embedding, lambda x: abs(x))) AS peak, 80::INT AS fitted FROM embeddings",
    "signal_percentiles": """WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN list_transform(embedding, lambda x: (x::DOUBLE * 0.001::DOUBLE)::FLOAT) ELSE embedding END AS embedding FROM embeddings),
        f AS (SELECT vec_id, sqrt(list_sum(list_transform(embedding[i * 4 + 1:i * 4 + 8], lambda x: x::DOUBLE * x::DOUBLE)) / 8)::FLOAT AS level FROM e, range(0, 15) r(i))
        SELECT vec_id, round(coalesce(quantile_cont(level::DOUBLE, 0.75) FILTER (level > 0.005::FLOAT), quantile_cont(level::DOUBLE, 0.75)), 5) AS level FROM f GROUP BY vec_id""",
    "signal_quietest": f"""WITH {_FINE.format(samples='embedding', source='embeddings', keys='vec_id', length='64', centre='64 / 400.0::DOUBLE')}
        SELECT vec_id, round(sec, 6) AS "at", round(level::DOUBLE, 5) AS level FROM q""",
    "signal_matched": """WITH f AS (SELECT vec_id, sqrt(list_sum(list_transform(embedding[i * 5 + 1:i * 5 + 10], lambda x: x::DOUBLE * x::DOUBLE)) / 10)::FLOAT AS level FROM embeddings, range(0, 11) r(i)),
        o AS (SELECT vec_id, coalesce(quantile_cont(level::DOUBLE, 0.75) FILTER (level > 0.005::FLOAT), quantile_cont(level::DOUBLE, 0.75)) AS own FROM f GROUP BY vec_id),
        g AS (SELECT vec_id, list_transform(embedding, lambda x: (x::DOUBLE * greatest(1 / 10 ** 0.6::DOUBLE, least(10 ** 0.6::DOUBLE, 0.1::DOUBLE / own)))::FLOAT) AS x FROM embeddings JOIN o USING (vec_id)),
        h AS (SELECT vec_id, list_max(list_transform(x, lambda v: abs(v)))::DOUBLE AS top, x FROM g),
        k AS (SELECT vec_id, CASE WHEN top > 0.99::DOUBLE THEN list_transform(x, lambda v: (v::DOUBLE * (0.99::DOUBLE / top))::FLOAT) ELSE x END AS x FROM h)
        SELECT vec_id, list_transform(range(0, 64), lambda i: round((x[i + 1]::DOUBLE * (CASE WHEN i < 4 THEN i / 3.0::DOUBLE ELSE 1 END)
          * (CASE WHEN 63 - i < 3 THEN (63 - i) / 2.0::DOUBLE ELSE 1 END))::FLOAT::DOUBLE, 4)) AS samples FROM k""",
    "seam_cuts": f"""WITH {_SPANS.format(n=10, step=0.55, length=0.1)}, {_FINE.format(samples='x', source='cut', keys='job_id, span', length='len(x)', centre='(l0 + h0) / 2 - low')}
        SELECT job_id, span AS seg_index, round(CASE WHEN level IS NULL THEN CASE WHEN high <= low THEN greatest(0, least(low, high)) ELSE low END ELSE sec + low END, 6) AS cut,
        coalesce(round(level::DOUBLE, 5), 'inf'::DOUBLE) AS level FROM cut LEFT JOIN q USING (job_id, span)""",
    "heard_bridges": f"""WITH {_SPANS.format(n=8, step=0.5, length=0.45).replace("embedding AS e", "CASE WHEN (vec_id // 16) % 2 = 0 THEN list_transform(embedding, lambda x: (x::DOUBLE * 0.02::DOUBLE)::FLOAT) ELSE embedding END AS e")},
        f AS (SELECT job_id, span, sqrt(list_sum(list_transform(x[k * 5 + 1:k * 5 + 10], lambda v: v::DOUBLE * v::DOUBLE)) / len(x[k * 5 + 1:k * 5 + 10]))::FLOAT AS level
          FROM cut, range(0, 300) r(k) WHERE len(x) > 0 AND (k * 5 + 10 <= len(x) OR k = 0))
        SELECT job_id, span, coalesce(quantile_cont(level::DOUBLE, 0.9) > 0.005::DOUBLE, false) AS loud FROM cut LEFT JOIN f USING (job_id, span) GROUP BY job_id, span""",
    "rendered_levels": """WITH s AS (SELECT vec_id // 16 AS job_id, (vec_id % 16) * 64 + i AS place, embedding[i + 1] AS x FROM embeddings, range(0, 64) r(i)),
        t AS (SELECT job_id, max(place) + 1 AS total FROM s GROUP BY job_id),
        o AS (SELECT job_id, total, i AS p FROM t, range(0, 741) r(i)),
        v AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 3),
        c AS (SELECT o.job_id, p, CASE WHEN p < 301 THEN coalesce(x, 0) * (CASE WHEN p < 2 THEN p / 1.0::DOUBLE ELSE 1 END) * (CASE WHEN 300 - p < 5 THEN (300 - p) / 4.0::DOUBLE ELSE 1 END)
            WHEN p >= 351 AND p < 431 THEN coalesce(e[p - 350], 0) * (CASE WHEN p - 351 < 4 THEN (p - 351) / 3.0::DOUBLE ELSE 1 END) * (CASE WHEN 430 - p < 4 THEN (430 - p) / 3.0::DOUBLE ELSE 1 END)
            WHEN p >= 501 THEN coalesce(x, 0) * (CASE WHEN p - 501 < 2 THEN (p - 501) / 1.0::DOUBLE ELSE 1 END) ELSE 0 END::FLOAT AS y
          FROM o, v LEFT JOIN s ON s.job_id = o.job_id AND s.place = CASE WHEN p < 301 THEN p + 20 WHEN p >= 501 THEN p - 501 + 400 END)
        SELECT job_id, (p // 64)::INT AS chunk_no, count(*)::INT AS n, round(sqrt(sum(y::DOUBLE * y::DOUBLE ORDER BY p) / count(*))::FLOAT::DOUBLE, 4) AS level FROM c GROUP BY job_id, p // 64""",
    "event_runs": """WITH g AS (SELECT user_id, ts, coalesce((ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) > INTERVAL 6 HOUR)::INT, 0) AS new FROM events),
        r AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM g)
        SELECT user_id, min(ts) AS run_start, max(ts) AS run_end, count(*) AS n FROM r GROUP BY user_id, run""",
    "event_keys": "SELECT DISTINCT user_id || '/' || event_type AS key FROM events",
}
