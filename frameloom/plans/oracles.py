"""DuckDB SQL for the queries of the catalogue."""

from __future__ import annotations

from ..config import DEFAULT

_N, _B = DEFAULT.nest, DEFAULT.buffer


def _inside(r) -> str:
    return f"(MASS_X > {r.xmin} AND MASS_X < {r.xmax} AND MASS_Y > {r.ymin} AND MASS_Y < {r.ymax})"


def _mix(round_: int, value: str) -> str:
    """60 bits of the md5 of the seed, the stratum, a round and a value."""
    return f"('0x' || substr(md5('42|' || coalesce(ANIMALID::VARCHAR, 'null') || '|' || coalesce(GAP_START_FRAME::VARCHAR, 'null') || '|' || coalesce(GAP_END_FRAME::VARCHAR, 'null') || '|{round_}|' || {value}), 1, 15))::BIGINT"


_PARTS = {
    "raw": """SELECT event_id + again AS _rowid, user_id AS ANIMALID, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) // 60000000 AS FRAMENUMBER,
               value AS MASS_X, CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS DOUBLE) AS MASS_Y, event_type AS EVENT_TYPE
        FROM events, (VALUES (0), (1000000000)) v(again) WHERE again = 0 OR event_id % 10 = 3""",
    "grp": """SELECT ANIMALID, FRAMENUMBER, count(*) AS n, min(_rowid) AS first, count(DISTINCT (MASS_X, MASS_Y, EVENT_TYPE)) = 1 AS agree
        FROM raw GROUP BY ANIMALID, FRAMENUMBER""",
    "det": f"""SELECT r.*, coalesce({_inside(_N)}, false)::INT AS IN_NEST, coalesce({_inside(_B)}, false) AS in_buffer
        FROM raw r JOIN grp g ON r._rowid = g.first WHERE agree""",
    "prs": """SELECT *, lead(FRAMENUMBER) OVER w AS nf, lead(IN_NEST) OVER w AS nn, lead(in_buffer) OVER w AS nb FROM det
        WINDOW w AS (PARTITION BY ANIMALID ORDER BY FRAMENUMBER)""",
    "gap": """SELECT ANIMALID, FRAMENUMBER AS GAP_START_FRAME, nf AS GAP_END_FRAME, nf - FRAMENUMBER - 1 AS size,
               IN_NEST::VARCHAR || nn::VARCHAR AS gap_type, CASE WHEN IN_NEST = 1 AND nb THEN 1 ELSE -1 END AS fill,
               CASE WHEN IN_NEST = 1 AND nb THEN 'logic' WHEN IN_NEST = 0 AND nn = 0 AND nf - FRAMENUMBER - 1 <= 900 THEN 'short_00'
                    WHEN IN_NEST = 0 AND nn = 0 THEN 'checkpoints' WHEN IN_NEST = 1 AND nn = 1 THEN 'type_11'
                    WHEN nf - FRAMENUMBER - 1 <= 900 THEN 'short' ELSE 'bisect' END AS route
        FROM prs WHERE nf - FRAMENUMBER > 1""",
    # One live segment [s, e] of type t per gap; f to l is what the answer a has just filled.
    "stp": """SELECT ANIMALID, GAP_START_FRAME AS gs, GAP_END_FRAME AS ge, gap_type, gap_type AS t, GAP_START_FRAME + 1 AS s,
               CASE WHEN gap_type = '00' THEN least(GAP_START_FRAME + 1800, GAP_END_FRAME - 1) ELSE GAP_END_FRAME - 1 END AS e,
               NULL::BIGINT AS f, NULL::BIGINT AS l, NULL::BIGINT AS a FROM gap WHERE route IN ('checkpoints', 'bisect')
        UNION ALL
        SELECT ANIMALID, gs, ge, gap_type, CASE WHEN t = '00' AND x = 1 THEN '10' ELSE t END,
               CASE WHEN t = '00' THEN e + 1 WHEN whole THEN 1 WHEN lft THEN m + 1 ELSE s END,
               CASE WHEN t = '00' AND x <> 1 THEN least(e + 1800, ge - 1) WHEN t = '00' THEN ge - 1 WHEN whole THEN 0 WHEN lft THEN e ELSE m - 1 END,
               CASE WHEN whole OR lft THEN s ELSE m END, CASE WHEN NOT whole AND lft THEN m ELSE e END, x
        FROM (SELECT *, x = -1 OR t = '00' OR e - s + 1 <= 1800 AS whole, (t = '10' AND x = 1) OR (t = '01' AND x = 0) AS lft
              FROM (SELECT *, CASE WHEN (m * 11 + ANIMALID) % 97 = 0 THEN -1 WHEN (m * 7 + ANIMALID * 13) % 100 < 45 THEN 1 ELSE 0 END::BIGINT AS x
                    FROM (SELECT *, CASE WHEN t = '00' THEN e ELSE (s + e) // 2 END AS m FROM stp WHERE s <= e)))""",
    "rev": "SELECT ANIMALID, gs AS GAP_START_FRAME, ge AS GAP_END_FRAME, gap_type, f AS seg_start, l AS seg_end, a AS value FROM stp WHERE f IS NOT NULL",
    "seg": """SELECT r.*, g.route, 'BINARY_SEARCH' AS source FROM rev r JOIN gap g USING (ANIMALID, GAP_START_FRAME)
        UNION ALL SELECT ANIMALID, GAP_START_FRAME, GAP_END_FRAME, gap_type, GAP_START_FRAME + 1, GAP_END_FRAME - 1, fill, route,
               CASE WHEN fill = 1 THEN 'LOGIC' ELSE 'UNKNOWN' END FROM gap WHERE route NOT IN ('checkpoints', 'bisect')""",
    "tot": """SELECT *, det_total - det_in AS det_out, bs_in + bs_out + bs_unknown AS searchable, det_in + logic_filled + bs_in AS final_in,
               det_total - det_in + bs_out AS final_out, threshold_skipped + zz_skipped + ze_skipped + bs_unknown AS final_unknown
        FROM (SELECT count(*) AS det_total, sum(IN_NEST)::BIGINT AS det_in FROM det),
             (SELECT count(*) AS total_gaps, sum(size)::BIGINT AS asm_total, coalesce(sum(size) FILTER (fill = 1), 0)::BIGINT AS logic_filled,
                     coalesce(sum(size) FILTER (fill = -1), 0)::BIGINT AS bs_input, coalesce(sum(size) FILTER (route = 'short'), 0)::BIGINT AS threshold_skipped,
                     coalesce(sum(size) FILTER (route = 'short_00'), 0)::BIGINT AS zz_skipped, coalesce(sum(size) FILTER (route = 'checkpoints'), 0)::BIGINT AS zz_reviewed,
                     coalesce(sum(size) FILTER (route = 'type_11'), 0)::BIGINT AS ze_skipped, coalesce(sum(size) FILTER (gap_type = '00'), 0)::BIGINT AS type_00,
                     coalesce(sum(size) FILTER (gap_type = '01'), 0)::BIGINT AS type_01, coalesce(sum(size) FILTER (gap_type = '10'), 0)::BIGINT AS type_10,
                     coalesce(sum(size) FILTER (gap_type = '11'), 0)::BIGINT AS type_11 FROM gap),
             (SELECT coalesce(sum(l - f + 1) FILTER (a = 1), 0)::BIGINT AS bs_in, coalesce(sum(l - f + 1) FILTER (a = 0), 0)::BIGINT AS bs_out,
                     coalesce(sum(l - f + 1) FILTER (a = -1), 0)::BIGINT AS bs_unknown FROM stp WHERE f IS NOT NULL)""",
    # The final timeline as ranges, and frame by frame.
    "rng": """SELECT ANIMALID, FRAMENUMBER AS first_frame, FRAMENUMBER AS last_frame, IN_NEST, 'DETECTED' AS ASSUMPTION_TYPE, NULL::BIGINT AS GAP_START_FRAME, NULL::BIGINT AS GAP_END_FRAME, 'DETECTED' AS FILL_SOURCE
        FROM det UNION ALL SELECT ANIMALID, seg_start, seg_end, value::INT, 'ASSUMED', GAP_START_FRAME, GAP_END_FRAME, source FROM seg""",
    "tml": "SELECT * EXCLUDE (first_frame, last_frame), unnest(range(first_frame, last_frame + 1)) AS FRAMENUMBER FROM rng",
    "lab": """SELECT *, CASE WHEN (FRAMENUMBER * 5 + ANIMALID) % 13 = 0 THEN NULL WHEN (FRAMENUMBER * 3 + ANIMALID) % 10 = 0 THEN 1 - IN_NEST ELSE IN_NEST END AS MANUAL_QC FROM tml""",
    "qcm": """SELECT *, FILL_SOURCE AS qc_mode FROM lab WHERE MANUAL_QC IS NOT NULL AND (ASSUMPTION_TYPE = 'DETECTED' OR IN_NEST IN (0, 1) AND FILL_SOURCE IN ('BINARY_SEARCH', 'LOGIC'))""",
    "cnf": """SELECT qc_mode, count(*) FILTER (IN_NEST = 1 AND MANUAL_QC = 1) AS TP, count(*) FILTER (IN_NEST = 1 AND MANUAL_QC = 0) AS FP,
               count(*) FILTER (IN_NEST = 0 AND MANUAL_QC = 1) AS FN, count(*) FILTER (IN_NEST = 0 AND MANUAL_QC = 0) AS TN,
               count(*) FILTER (IN_NEST IN (0, 1)) AS total_labeled, count(*) FILTER (IN_NEST NOT IN (0, 1)) AS invalid FROM qcm GROUP BY qc_mode""",
    "pol": "SELECT *, last_frame - first_frame + 1 AS n FROM rng WHERE FILL_SOURCE = 'BINARY_SEARCH' AND IN_NEST IN (0, 1)",
    "alc": """SELECT ANIMALID, GAP_START_FRAME, GAP_END_FRAME, size, base + CASE WHEN row_number() OVER (ORDER BY rest DESC, ANIMALID NULLS LAST, GAP_START_FRAME NULLS LAST, GAP_END_FRAME NULLS LAST) <= 100 - sum(base) OVER () THEN 1 ELSE 0 END AS allocated
        FROM (SELECT *, 100 * size // sum(size) OVER () AS base, 100 * size % sum(size) OVER () AS rest
              FROM (SELECT ANIMALID, GAP_START_FRAME, GAP_END_FRAME, sum(n)::BIGINT AS size FROM pol GROUP BY ALL))""",
    # The places of a stratum's frames, permuted by four rounds over a rectangle of a columns and b rows, again while outside of the stratum.
    "wlk": f"""SELECT ANIMALID, GAP_START_FRAME, GAP_END_FRAME, size, i, i AS x, 0 AS k, ceil(sqrt(size::DOUBLE))::BIGINT AS a, (size + ceil(sqrt(size::DOUBLE))::BIGINT - 1) // ceil(sqrt(size::DOUBLE))::BIGINT AS b
        FROM (SELECT *, unnest(range(allocated::BIGINT)) AS i FROM alc WHERE allocated > 0)
        UNION ALL SELECT ANIMALID, GAP_START_FRAME, GAP_END_FRAME, size, i, l + a * ((r + {_mix(3, "l")}) % b), k + 1, a, b
        FROM (SELECT * REPLACE ((l + {_mix(2, "r")}) % a AS l) FROM (SELECT * REPLACE ((r + {_mix(1, "l")}) % b AS r)
        FROM (SELECT * REPLACE ((l + {_mix(0, "r")}) % a AS l) FROM (SELECT *, x % a AS l, x // a AS r FROM wlk WHERE k = 0 OR x >= size))))""",
    "smp": """SELECT p.* EXCLUDE (ahead), first_frame + x - ahead AS FRAMENUMBER FROM wlk w
        JOIN (SELECT *, (sum(n) OVER (PARTITION BY ANIMALID, GAP_START_FRAME, GAP_END_FRAME ORDER BY first_frame ROWS UNBOUNDED PRECEDING))::BIGINT - n AS ahead FROM pol) p
        ON p.ANIMALID = w.ANIMALID AND p.GAP_START_FRAME = w.GAP_START_FRAME AND p.GAP_END_FRAME = w.GAP_END_FRAME AND x >= ahead AND x < ahead + n WHERE k > 0 AND x < size""",
    "fil": """SELECT CASE WHEN contains(url, 'ref=') THEN '/videos/cam_' || page_id || '_final.mp4' ELSE '/videos/cam_t' || page_id * 7919 % 50000 || '.mp4' END AS path, length(html) % 200 + 1 AS frame_count,
               CASE WHEN length(html) % 10 = 4 THEN 12.0 ELSE 15.0 END::DOUBLE AS fps FROM pages""",
    "vid": """SELECT nullif(regexp_extract(path, 't([0-9]+)\\.[A-Za-z0-9]+$', 1), '')::BIGINT AS start, start + frame_count * 2 AS "end", path, frame_count::BIGINT AS frame_count, fps
        FROM fil WHERE regexp_extract(path, 't([0-9]+)\\.[A-Za-z0-9]+$', 1) <> ''""",
    # Whether a video covers a frame, and the ones around it, depend on the frame's number alone.
    "cov": """SELECT f, arg_min({'path': path, 'start': start, 'n': frame_count}, (start, path)) AS v FROM (SELECT DISTINCT FRAMENUMBER AS f FROM frm) JOIN vid ON f >= start AND f < "end" GROUP BY f""",
    "opt": """SELECT f, f AS resolved, v, 0 AS d, 0 AS side FROM cov UNION ALL
        SELECT f, max("end") - 2, arg_max({'path': path, 'start': start, 'n': frame_count}, ("end", -start)), f - (max("end") - 2), 0 FROM (SELECT DISTINCT FRAMENUMBER AS f FROM frm) JOIN vid ON "end" <= f WHERE f NOT IN (SELECT f FROM cov) GROUP BY f UNION ALL
        SELECT f, min(start), arg_min({'path': path, 'start': start, 'n': frame_count}, (start, path)), min(start) - f, 1 FROM (SELECT DISTINCT FRAMENUMBER AS f FROM frm) JOIN vid ON start > f WHERE f NOT IN (SELECT f FROM cov) GROUP BY f""",
    "cnd": """SELECT ANIMALID, FRAMENUMBER, candidate_rank, resolved, v.path AS path, v.start AS start, v.n AS frame_count FROM frm
        JOIN (SELECT *, row_number() OVER (PARTITION BY f ORDER BY d, side) AS candidate_rank FROM opt) ON f = FRAMENUMBER""",
    "res": """SELECT ANIMALID, FRAMENUMBER, min(candidate_rank)::INT AS candidate_rank, arg_min(resolved, candidate_rank) AS resolved, regexp_replace(arg_min(path, candidate_rank), '.*/', '') AS video,
               greatest(0, least(round_even((arg_min(resolved, candidate_rank) - arg_min(start, candidate_rank)) / 2.0, 0)::BIGINT, arg_min(frame_count, candidate_rank) - 1)) AS local_frame
        FROM cnd WHERE frame_count % 5 <> 0 GROUP BY ANIMALID, FRAMENUMBER""",
    "den": """SELECT user_id AS ANIMALID, epoch_us(ts) // 3600000000 // 12 - epoch_us(TIMESTAMP '2024-01-01') // 3600000000 // 12 AS FRAMENUMBER, arg_max(value, event_id) AS MASS_X,
               arg_max(CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS DOUBLE), event_id) AS MASS_Y FROM events GROUP BY 1, 2""",
    "nbr": """SELECT *, lag(FRAMENUMBER) OVER w AS f0, lag(MASS_X) OVER w AS x0, lag(MASS_Y) OVER w AS y0, lead(FRAMENUMBER) OVER w AS f2, lead(MASS_X) OVER w AS x2, lead(MASS_Y) OVER w AS y2,
               lead(FRAMENUMBER, 2) OVER w AS f3, lead(MASS_X, 2) OVER w AS x3, lead(MASS_Y, 2) OVER w AS y3 FROM den WINDOW w AS (PARTITION BY ANIMALID ORDER BY FRAMENUMBER)""",
    "bts": """SELECT ANIMALID, min(FRAMENUMBER) AS start_frame, count(*) AS pairs, count(*) / 30.0::DOUBLE AS duration_sec FROM (
          SELECT *, sum(CASE WHEN still THEN 0 ELSE 1 END) OVER (PARTITION BY ANIMALID ORDER BY FRAMENUMBER) AS run FROM (
            SELECT *, f2 - FRAMENUMBER = 1 AND sqrt((x2 - MASS_X) * (x2 - MASS_X) + (y2 - MASS_Y) * (y2 - MASS_Y)) < 40 AS still FROM nbr WHERE f2 IS NOT NULL)) WHERE still
        GROUP BY ANIMALID, run HAVING count(*) >= 3""",
    "vel": """SELECT ANIMALID, FRAMENUMBER AS start_frame, f2 AS end_frame, f2 - FRAMENUMBER - 1 AS gap_length_frames, (f2 - FRAMENUMBER - 1) / 30.0::DOUBLE AS gap_duration_sec,
               CASE WHEN FRAMENUMBER - f0 = 1 THEN sqrt((MASS_X - x0) * (MASS_X - x0) + (MASS_Y - y0) * (MASS_Y - y0)) / (1.0::DOUBLE / 30.0::DOUBLE) END AS velocity_before_px_per_sec,
               CASE WHEN f3 - f2 = 1 THEN sqrt((x3 - x2) * (x3 - x2) + (y3 - y2) * (y3 - y2)) / (1.0::DOUBLE / 30.0::DOUBLE) END AS velocity_after_px_per_sec,
               row_number() OVER (PARTITION BY ANIMALID ORDER BY FRAMENUMBER) AS gap_index FROM nbr WHERE f2 - FRAMENUMBER > 1""",
}
_NEEDS = {
    "raw": "", "grp": "raw", "det": "raw grp", "prs": "det", "gap": "prs", "stp": "gap", "rev": "stp", "seg": "rev gap", "tot": "det gap stp", "rng": "det seg", "tml": "rng", "lab": "tml", "qcm": "lab", "cnf": "qcm",
    "pol": "rng", "alc": "pol", "wlk": "alc", "smp": "pol wlk", "fil": "", "vid": "fil", "frm": "det", "cov": "frm vid", "opt": "cov", "cnd": "opt", "res": "cnd", "den": "", "nbr": "den", "bts": "nbr", "vel": "nbr",
}
_PARTS["frm"] = "SELECT ANIMALID, FRAMENUMBER FROM det"


def _sql(parts: str, body: str, **other: str) -> str:
    """A query over some of the parts, with those that they need before them."""
    done: list[str] = []

    def add(p: str) -> None:
        for q in _NEEDS[p].split():
            add(q)
        if p not in done:
            done.append(p)

    for p in parts.split():
        add(p)
    # Parts are used several times; they are computed once.
    return "WITH RECURSIVE " + ", ".join(f"{p} AS {'' if p in ('stp', 'wlk') else 'MATERIALIZED '}({other.get(p, _PARTS[p])})" for p in done) + " " + body


_HMS = "printf('%02d:%02d:%02d', floor({s})::BIGINT // 3600, floor({s})::BIGINT % 3600 // 60, floor({s})::BIGINT % 60)"


def _timed(select: str) -> str:
    s = "(frames / 30.0::DOUBLE)"
    return f"SELECT *, {_HMS.format(s=s)} AS duration, {s} / 3600.0::DOUBLE AS hours FROM ({select})"


def _lines(rows: list[tuple[str, str]]) -> str:
    return " UNION ALL ".join(f"SELECT {k}::INT AS line, '{label}' AS label, ({v})::BIGINT AS frames FROM tot" for k, (label, v) in enumerate(rows, 1))


def _pct(part: str, whole: str) -> str:
    return f"CASE WHEN {whole} > 0 THEN 100.0::DOUBLE * ({part}) / {whole} ELSE 0.0::DOUBLE END"


def _spread(table: str, frames: str, by: str = "ANIMALID,") -> str:
    q = ", ".join(f"coalesce(quantile_cont({frames}, {p}) / 30.0::DOUBLE, 0.0) AS {n}" for p, n in ((0.25, "p25"), (0.5, "p50"), (0.75, "p75")))
    return f"SELECT {by} count({frames}) AS n, coalesce(sum({frames})::DOUBLE / count({frames}) / 30.0::DOUBLE, 0.0) AS mean, coalesce(max({frames}) / 30.0::DOUBLE, 0.0) AS max, {q} FROM {table} {'GROUP BY ALL' if by else ''}"


def _bins(table: str, column: str, beyond: float) -> str:
    return f"""SELECT ANIMALID, least(floor(m * b / (x + {beyond}::DOUBLE)), b - 1)::BIGINT AS bin, count(*) AS n
        FROM (SELECT ANIMALID, {column} / 60.0::DOUBLE AS m FROM {table})
        JOIN (SELECT ANIMALID, max({column} / 60.0::DOUBLE) AS x, least(60, greatest(10, count(*) // 2)) AS b FROM {table} GROUP BY 1) USING (ANIMALID) GROUP BY 1, 2"""


def _check(label: str, expected: str, actual: str) -> str:
    return f"SELECT '{label}' AS label, ({expected})::BIGINT AS expected, ({actual})::BIGINT AS actual, ({expected}) = ({actual}) AS ok FROM tot"


def _pool(where: str) -> str:
    return _sql("rng", f"SELECT ANIMALID, first_frame, last_frame, IN_NEST, GAP_START_FRAME, GAP_END_FRAME FROM rng WHERE {where}")


_SUMS = "count(*) AS n, sum(FRAMENUMBER)::BIGINT AS frame_sum, sum(FRAMENUMBER * FRAMENUMBER % 1000003)::BIGINT AS square_sum"


_RATE = "CASE WHEN {d} <> 0 THEN ({n})::DOUBLE / ({d}) ELSE 0.0::DOUBLE END"
_RATES = ", ".join(f"{_RATE.format(n=n, d=d)} AS {k}" for k, n, d in (("accuracy", "TP + TN", "(TP + TN + FP + FN)"), ("error_rate", "FP + FN", "(TP + TN + FP + FN)"), ("sensitivity", "TP", "(TP + FN)"), ("specificity", "TN", "(TN + FP)")))
_KEY = "ANIMALID, GAP_START_FRAME, GAP_END_FRAME"

ORACLES: dict[str, str] = {
    "q_dedup_clean": _sql("grp", "SELECT r.* FROM raw r JOIN grp ON _rowid = first WHERE agree"),
    "q_dedup_stats": _sql("grp", """SELECT (SELECT count(*) FROM raw) AS rows_before, 0::BIGINT AS missing_identity, count(*) FILTER (n > 1 AND agree) AS case_a_groups, coalesce(sum(n) FILTER (n > 1 AND agree), 0)::BIGINT AS case_a_rows,
        count(*) FILTER (NOT agree) AS case_b_groups, coalesce(sum(n) FILTER (NOT agree), 0)::BIGINT AS case_b_rows, count(*) FILTER (agree) AS rows_after FROM grp"""),
    "q_dedup_conflict_examples": _sql("grp", "SELECT ANIMALID, FRAMENUMBER, n, first AS first_rowid FROM grp WHERE NOT agree ORDER BY first LIMIT 10"),
    "q_detected_classify": _sql("det", "SELECT ANIMALID, FRAMENUMBER, IN_NEST, in_buffer FROM det"),
    "q_detected_counts": _sql("det", "SELECT ANIMALID, count(*) AS detected, sum(IN_NEST)::BIGINT AS detected_in, sum(1 - IN_NEST)::BIGINT AS detected_out FROM det GROUP BY 1"),
    "q_gap_table": _sql("gap", f"SELECT {_KEY}, size, fill FROM gap"),
    "q_gap_fill_timeline": _sql("gap det", """SELECT ANIMALID, FRAMENUMBER AS first_frame, FRAMENUMBER AS last_frame, IN_NEST, 'DETECTED' AS ASSUMPTION_TYPE, NULL::BIGINT AS GAP_START_FRAME, NULL::BIGINT AS GAP_END_FRAME FROM det
        UNION ALL SELECT ANIMALID, GAP_START_FRAME + 1, GAP_END_FRAME - 1, fill, 'ASSUMED', GAP_START_FRAME, GAP_END_FRAME FROM gap"""),
    "q_gap_fill_frames": _sql("gap det", f"""SELECT ANIMALID, ASSUMPTION_TYPE, IN_NEST, {_SUMS} FROM (SELECT ANIMALID, FRAMENUMBER, IN_NEST, 'DETECTED' AS ASSUMPTION_TYPE FROM det
        UNION ALL SELECT ANIMALID, unnest(range(GAP_START_FRAME + 1, GAP_END_FRAME)), fill, 'ASSUMED' FROM gap) GROUP BY 1, 2, 3"""),
    "q_gap_fill_summary": _sql("gap det", """SELECT ANIMALID, detected, detected_in, detected_out, coalesce(n_gaps, 0) AS n_gaps, coalesce(missing, 0) AS missing, coalesce(logic_filled, 0) AS logic_filled,
        (detected_in + coalesce(logic_filled, 0)) / 30.0::DOUBLE AS time_in_nest_sec
        FROM (SELECT ANIMALID, count(*) AS detected, sum(IN_NEST)::BIGINT AS detected_in, sum(1 - IN_NEST)::BIGINT AS detected_out FROM det GROUP BY 1)
        LEFT JOIN (SELECT ANIMALID, count(*) AS n_gaps, sum(size)::BIGINT AS missing, coalesce(sum(size) FILTER (fill = 1), 0)::BIGINT AS logic_filled FROM gap GROUP BY 1) USING (ANIMALID)"""),
    "q_nonincreasing_guard": _sql("raw", "SELECT ANIMALID, FRAMENUMBER, count(*) - 1 AS repeats FROM raw GROUP BY 1, 2 HAVING count(*) > 1 ORDER BY 1, 2 LIMIT 10"),
    "q_gap_stream": _sql("gap", f"SELECT {_KEY}, size, gap_type, fill, route FROM gap"),
    "q_gap_types": _sql("gap", f"SELECT {_KEY}, gap_type FROM gap"),
    "q_gap_type_frames": _sql("gap", "SELECT t AS gap_type, count(g.gap_type) AS n_gaps, coalesce(sum(size), 0)::BIGINT AS frames FROM (VALUES ('00'), ('01'), ('10'), ('11')) v(t) LEFT JOIN gap g ON t = g.gap_type GROUP BY t"),
    "q_gap_routes": _sql("gap", f"SELECT {_KEY}, route, row_number() OVER (PARTITION BY ANIMALID ORDER BY GAP_START_FRAME, GAP_END_FRAME)::INT AS gap_index, count(*) OVER (PARTITION BY ANIMALID) AS total_gaps FROM gap WHERE fill = -1"),
    "q_boundary_asof": _sql("gap det", f"""SELECT g.ANIMALID, g.GAP_START_FRAME, g.GAP_END_FRAME, b.IN_NEST AS state_before, e.IN_NEST AS state_after
        FROM (SELECT ANIMALID, GAP_START_FRAME + 1 AS GAP_START_FRAME, GAP_END_FRAME - 1 AS GAP_END_FRAME FROM gap) g
        ASOF JOIN det b ON g.ANIMALID = b.ANIMALID AND g.GAP_START_FRAME >= b.FRAMENUMBER ASOF JOIN det e ON g.ANIMALID = e.ANIMALID AND g.GAP_END_FRAME <= e.FRAMENUMBER"""),
    "q_type00_checkpoints": _sql("gap", f"""SELECT {_KEY}, k, GAP_START_FRAME + 1 + 1800 * k AS seg_start, least(GAP_START_FRAME + 1800 + 1800 * k, GAP_END_FRAME - 1) AS seg_end
        FROM (SELECT *, unnest(range((size - 1) // 1800 + 1)) AS k FROM gap WHERE route = 'checkpoints')"""),
    "q_review_segments": _sql("rev", "SELECT * FROM rev"),
    "q_review_answers_table": _sql("rev", "SELECT * FROM rev"),
    "q_live_review": _sql("rev", "SELECT * FROM rev"),
    "q_review_timeline": _sql("rng", "SELECT * FROM rng"),
    "q_review_frames": _sql("tml", f"SELECT ANIMALID, FILL_SOURCE, IN_NEST, {_SUMS} FROM tml GROUP BY 1, 2, 3"),
    "q_fill_source_counts": _sql("seg det", """SELECT source AS FILL_SOURCE, value::INT AS IN_NEST, sum(seg_end - seg_start + 1)::BIGINT AS frames FROM seg GROUP BY 1, 2
        UNION ALL SELECT 'DETECTED', IN_NEST, count(*) FROM det GROUP BY 1, 2"""),
    "q_time_in_nest": _sql("tot", _timed(_lines([("total", "final_in"), ("detected", "det_in"), ("logic-filled", "logic_filled"), ("binary-search", "bs_in")]))),
    "q_processing_breakdown": _sql("tot", _timed(_lines([("detected", "det_total"), ("logic-filled", "logic_filled"), ("sent to review", "bs_input"), ("reviewed", "searchable"), ("short 01/10 gaps", "threshold_skipped"), ("short 00 gaps", "zz_skipped"), ("reviewed 00 gaps", "zz_reviewed"), ("11 gaps", "ze_skipped")]))),
    "q_review_results": _sql("tot", " UNION ALL ".join(f"SELECT '{k}' AS label, {v} AS frames, {_pct(v, 'bs_input')} AS percent FROM tot" for k, v in (("in", "bs_in"), ("out", "bs_out"), ("unknown", "bs_unknown"), ("short 01/10", "threshold_skipped"), ("short 00", "zz_skipped"), ("type 11", "ze_skipped")))),
    "q_unknown_pools": _sql("tot", " UNION ALL ".join(f"SELECT '{k}' AS pool, {v} AS frames, {_pct(v, 'final_unknown')} AS percent FROM tot" for k, v in (("A: never reviewed", "threshold_skipped + zz_skipped"), ("B: reviewer skipped", "bs_unknown"), ("type 11", "ze_skipped")))),
    "q_audit_table": _sql("tot", _timed("SELECT *, (sum(frames) OVER (ORDER BY line))::BIGINT AS running FROM (" + _lines([("Detected IN", "det_in"), ("Detected OUT", "det_out"), ("Logic-filled IN", "logic_filled"), ("Binary-search IN", "bs_in"), ("Binary-search OUT", "bs_out"), ("Remaining UNKNOWN", "final_unknown")]) + ")")),
    "q_gap_details": _sql("seg", f"""SELECT *, CASE WHEN route = 'short_00' THEN 'skipped: short 00' WHEN route = 'type_11' THEN 'skipped: 11' WHEN route = 'logic' THEN 'logic-filled' WHEN route = 'short' THEN 'skipped: short'
          WHEN in_frames > 0 AND out_frames = 0 AND unknown_frames = 0 THEN 'reviewed: in' WHEN out_frames > 0 AND in_frames = 0 AND unknown_frames = 0 THEN 'reviewed: out' ELSE 'reviewed: mixed' END AS label,
          GAP_END_FRAME - GAP_START_FRAME - 1 AS frames
        FROM (SELECT {_KEY}, gap_type, route, {", ".join(f"coalesce(sum(seg_end - seg_start + 1) FILTER (value = {v}), 0)::BIGINT AS {k}_frames" for v, k in ((1, "in"), (0, "out"), (-1, "unknown")))} FROM seg GROUP BY ALL)"""),
    "q_integrity_checks": _sql("tot rev gap", " UNION ALL ".join([
        _check("logic_filled + bs_input = asm_total", "asm_total", "logic_filled + bs_input"), _check("det + asm = total", "det_in + det_out + asm_total", "det_total + asm_total"),
        _check("bs_input is accounted for", "bs_input", "searchable + threshold_skipped + zz_skipped + ze_skipped"), _check("final classes = total", "det_total + asm_total", "final_in + final_out + final_unknown"),
        _check("gap types = asm_total", "asm_total", "type_00 + type_01 + type_10 + type_11"),
        _check("gaps without a known type", "0", "(SELECT count(*) FROM gap WHERE gap_type NOT IN ('00', '01', '10', '11'))"),
        _check("reviewed gaps whose ranges do not sum up", "0", "(SELECT count(*) FROM (SELECT g.size, sum(r.seg_end - r.seg_start + 1) AS n FROM gap g JOIN rev r USING (ANIMALID, GAP_START_FRAME) GROUP BY g.ANIMALID, GAP_START_FRAME, g.size) WHERE n <> size)")])),
    "q_gap_stats_hms": _sql("tot", f"SELECT total_gaps, asm_total, m AS mean_sec, {_HMS.format(s='m')} AS mean_hms, m / 3600.0::DOUBLE AS mean_hours FROM (SELECT *, CASE WHEN total_gaps <> 0 THEN asm_total::DOUBLE / total_gaps ELSE 0.0 END / 30.0::DOUBLE AS m FROM tot)"),
    "q_pool_detected": _pool("ASSUMPTION_TYPE = 'DETECTED'"),
    "q_pool_binary_search": _pool("FILL_SOURCE = 'BINARY_SEARCH' AND IN_NEST IN (0, 1)"),
    "q_pool_logic": _pool("FILL_SOURCE = 'LOGIC' AND IN_NEST IN (0, 1)"),
    "q_pool_assumed_legacy": _pool("ASSUMPTION_TYPE = 'ASSUMED' AND IN_NEST IN (0, 1)"),
    "q_gap_totals": _sql("seg gap", f"""SELECT (SELECT count(*) FROM gap) AS n_gaps, (SELECT sum(size)::BIGINT FROM gap) AS frames, {", ".join(f"coalesce(sum(seg_end - seg_start + 1) FILTER (value = {v}), 0)::BIGINT AS {k}_frames" for v, k in ((1, "in"), (0, "out"), (-1, "unknown")))},
        sum(seg_end - seg_start + 1)::BIGINT = (SELECT sum(size)::BIGINT FROM gap) AS balanced FROM seg"""),
    "q_gap_review_time": _sql("gap", f"SELECT {_KEY}, CASE WHEN route IN ('checkpoints', 'bisect') THEN {_HMS.format(s='((GAP_START_FRAME + 1) % 7200)')} ELSE 'N/A' END AS review_time FROM gap"),
    "q_detection_summary": _sql("tot", f"SELECT t.*, {_pct('frames', 'det_total')} AS percent FROM ({_timed(_lines([('detected', 'det_total'), ('in', 'det_in'), ('out', 'det_out')]))}) t, tot"),
    "q_pool_legacy_schema": _sql("rng", """SELECT 'flag' AS schema, 'BINARY_SEARCH' AS mode, sum(last_frame - first_frame + 1) FILTER (FILL_SOURCE = 'BINARY_SEARCH')::BIGINT AS n FROM rng WHERE ASSUMPTION_TYPE = 'ASSUMED' AND IN_NEST IN (0, 1)
        UNION ALL SELECT 'flag', 'LOGIC', sum(last_frame - first_frame + 1) FILTER (FILL_SOURCE <> 'BINARY_SEARCH')::BIGINT FROM rng WHERE ASSUMPTION_TYPE = 'ASSUMED' AND IN_NEST IN (0, 1)
        UNION ALL SELECT 'none', v, (SELECT sum(last_frame - first_frame + 1)::BIGINT FROM rng WHERE ASSUMPTION_TYPE = 'ASSUMED' AND IN_NEST IN (0, 1)) FROM (VALUES ('LOGIC'), ('ASSUMED')) t(v)"""),
    "q_sample_allocation": _sql("alc", "SELECT ANIMALID, GAP_START_FRAME, GAP_END_FRAME, size, allocated::BIGINT AS allocated FROM alc"),
    "q_sample_allocation_detected": _sql("alc", "SELECT ANIMALID, GAP_START_FRAME, GAP_END_FRAME, size, allocated::BIGINT AS allocated FROM alc", pol="SELECT *, 1 AS n FROM rng WHERE ASSUMPTION_TYPE = 'DETECTED'"),
    "q_sample_allocation_plain": _sql("rng", "SELECT sum(last_frame - first_frame + 1)::BIGINT AS size, 100::BIGINT AS allocated FROM rng"),
    "q_stratified_sample": _sql("smp", "SELECT ANIMALID, FRAMENUMBER, IN_NEST, GAP_START_FRAME, GAP_END_FRAME FROM smp"),
    "q_video_map": _sql("vid", "SELECT * FROM vid"),
    "q_video_rejects": _sql("fil", """SELECT * FROM (SELECT regexp_replace(path, '.*/', '') AS name, CASE WHEN regexp_extract(path, 't([0-9]+)\\.[A-Za-z0-9]+$', 1) = '' THEN 'unparseable' WHEN fps > 0 AND abs(fps - 15) > 0.5 THEN 'fps mismatch' END AS reason FROM fil) WHERE reason IS NOT NULL"""),
    "q_frame_exact": _sql("cnd", "SELECT ANIMALID, FRAMENUMBER, path FROM cnd WHERE resolved = FRAMENUMBER"),
    "q_frame_candidates": _sql("cnd", "SELECT ANIMALID, FRAMENUMBER, candidate_rank::INT AS candidate_rank, resolved, path FROM cnd"),
    "q_frame_resolved_local": _sql("res", "SELECT * FROM res"),
    "q_qc_samples": _sql("smp res", """SELECT row_number() OVER (ORDER BY s.ANIMALID, s.FRAMENUMBER)::INT AS sample_id, s.ANIMALID AS animal_id, video, resolved AS frame_global, s.FRAMENUMBER AS requested_frame, IN_NEST, ASSUMPTION_TYPE, FILL_SOURCE, GAP_START_FRAME, GAP_END_FRAME,
        printf('S%04d_A%d_G%d_%s.png', row_number() OVER (ORDER BY s.ANIMALID, s.FRAMENUMBER), s.ANIMALID, s.FRAMENUMBER, regexp_replace(video, '\\.[^.]*$', '')) AS screenshot,
        CASE WHEN resolved = s.FRAMENUMBER THEN 'exact' ELSE 'nearest available - requested ' || s.FRAMENUMBER END AS caption, 'BINARY_SEARCH' AS QC_MODE
        FROM smp s JOIN res r USING (ANIMALID, FRAMENUMBER)""", frm="SELECT ANIMALID, FRAMENUMBER FROM smp"),
    "q_confusion_by_mode": _sql("cnf", "SELECT * FROM cnf"),
    "q_qc_metrics": _sql("cnf", f"SELECT qc_mode, {_RATES} FROM cnf"),
    "q_fp_fn_list": _sql("lab", "SELECT CASE WHEN IN_NEST = 1 THEN 'FP' ELSE 'FN' END AS kind, FRAMENUMBER AS sample_id, printf('A%d_G%d.png', ANIMALID, FRAMENUMBER) AS screenshot FROM lab WHERE ASSUMPTION_TYPE = 'DETECTED' AND MANUAL_QC = 1 - IN_NEST"),
    "q_excluded_counts": _sql("rng", "SELECT sum(last_frame - first_frame + 1)::BIGINT AS total, sum(last_frame - first_frame + 1) FILTER (FILL_SOURCE = 'BINARY_SEARCH' AND IN_NEST IN (0, 1))::BIGINT AS eligible, total - eligible AS excluded FROM rng"),
    "q_labels_confusion": f"SELECT *, {_RATES} FROM (SELECT count(*) FILTER (quality = 1 AND toxic = 1) AS TP, count(*) FILTER (quality = 1 AND toxic = 0) AS FP, count(*) FILTER (quality = 0 AND toxic = 1) AS FN, count(*) FILTER (quality = 0 AND toxic = 0) AS TN, count(*) FILTER (quality IN (0, 1)) AS total_labeled, count(*) FILTER (NOT coalesce(quality IN (0, 1), false)) AS invalid FROM labels WHERE toxic IS NOT NULL)",
    "q_bouts": _sql("bts", "SELECT * FROM bts"),
    "q_bout_stats": _sql("bts", _spread("bts", "pairs")),
    "q_suggest_threshold": _sql("bts den", """SELECT ANIMALID, CASE WHEN count(pairs) = 0 THEN 30 ELSE greatest(5, least(60, ceil(quantile_cont(pairs, 0.75) / 30.0::DOUBLE / 60 / 5) * 5)) END::BIGINT AS suggested_minutes
        FROM (SELECT DISTINCT ANIMALID FROM den) LEFT JOIN bts USING (ANIMALID) GROUP BY ANIMALID"""),
    "q_bout_histogram": _sql("bts", _bins("bts", "duration_sec", 1.0)),
    "q_velocity_gaps": _sql("vel", "SELECT * FROM vel"),
    "q_gap_percentiles": _sql("vel", _spread("vel", "gap_length_frames")),
    "q_gap_percentiles_all": _sql("gap", _spread("gap", "size", "")),
    "q_gap_histogram": _sql("vel", _bins("vel", "gap_duration_sec", 0.1)),
    "q_recording_overview": _sql("det", f"SELECT *, {_HMS.format(s='duration_sec')} AS duration, duration_sec / 3600.0::DOUBLE AS hours FROM (SELECT ANIMALID, count(*) AS n, min(FRAMENUMBER) AS first_frame, max(FRAMENUMBER) AS last_frame, (max(FRAMENUMBER) - min(FRAMENUMBER)) / 30.0::DOUBLE AS duration_sec FROM det GROUP BY 1)"),
    "q_trajectory_norm": _sql("det", "SELECT ANIMALID, FRAMENUMBER, (FRAMENUMBER - min(FRAMENUMBER) OVER w)::DOUBLE / greatest(max(FRAMENUMBER) OVER w - min(FRAMENUMBER) OVER w, 1)::DOUBLE AS t FROM det WINDOW w AS (PARTITION BY ANIMALID)"),
    "q_frame_range_cut": _sql("raw", "SELECT 'detection' AS table_name, count(*) AS n FROM raw WHERE FRAMENUMBER BETWEEN 1000 AND 20000 UNION ALL SELECT 'regions', 1"),
    "q_roi_metadata_roundtrip": _sql("det", f"SELECT DISTINCT ANIMALID, {', '.join(f'{v}::DOUBLE AS {k}_{n}' for k, r in (('NEST', _N), ('BUFFER', _B)) for n, v in (('XMIN', r.xmin), ('XMAX', r.xmax), ('YMIN', r.ymin), ('YMAX', r.ymax)))} FROM det"),
    "q_answer_log_replay": """WITH RECURSIVE ev AS (SELECT user_id AS session, event_id AS seq, CASE WHEN event_type = 'error' THEN 'UNDO' WHEN event_id % 7 = 0 THEN 'REDO' ELSE 'ANSWER' END AS kind,
          {'seq': event_id, 'gap': event_id % 50, 'answer': (event_id % 3 - 1)::INT} AS x, event_id % 11 = 0 AS stale, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
        st(session, k, done, undone) AS (SELECT DISTINCT session, 0::BIGINT, []::STRUCT(seq BIGINT, gap BIGINT, answer INTEGER)[], []::STRUCT(seq BIGINT, gap BIGINT, answer INTEGER)[] FROM ev
          UNION ALL SELECT s.session, e.k,
            CASE WHEN stale THEN done WHEN kind = 'ANSWER' THEN list_append(done, x) WHEN kind = 'UNDO' THEN done[1 : len(done) - 1] WHEN len(undone) > 0 THEN list_append(done, undone[len(undone)]) ELSE done END,
            CASE WHEN stale THEN undone WHEN kind = 'ANSWER' THEN [] WHEN kind = 'UNDO' THEN CASE WHEN len(done) > 0 THEN list_append(undone, done[len(done)]) ELSE undone END ELSE undone[1 : len(undone) - 1] END
          FROM st s JOIN ev e ON e.session = s.session AND e.k = s.k + 1),
        fin AS (SELECT session, arg_max(done, k) AS done FROM st GROUP BY session)
        SELECT session, position, d.seq AS seq, d.gap AS gap, d.answer AS answer FROM (SELECT session, unnest(done) AS d, unnest(range(1, len(done) + 1)) AS position FROM fin)""",
    "q_review_seconds": """WITH v AS (SELECT *, sum(CASE WHEN gap <> before THEN 1 ELSE 0 END) OVER (PARTITION BY session ORDER BY seq) AS visit FROM (
          SELECT user_id AS session, event_id AS seq, event_id % 50 AS gap, ts, lag(event_id % 50) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events))
        SELECT session, gap, arg_min(d, visit) AS duration_sec FROM (SELECT session, gap, visit, epoch_us(max(ts)) / 1e6::DOUBLE - epoch_us(min(ts)) / 1e6::DOUBLE AS d FROM v GROUP BY ALL) GROUP BY session, gap""",
    "q_label_metrics": f"""WITH l AS (SELECT event_id % 500 AS sample_id, max({{'s': event_id, 'l': CASE WHEN event_type = 'view' THEN NULL WHEN value > 99 THEN 2 ELSE user_id % 2 END}}).l AS label FROM events GROUP BY 1),
        p AS (SELECT event_id % 500 AS sample_id, arg_min(event_type, event_id) AS t, arg_min(value, event_id) AS v FROM events GROUP BY 1),
        j AS (SELECT CASE WHEN t IN ('click', 'error') THEN 'LOGIC' ELSE 'DETECTED' END AS qc_mode, CASE WHEN t = 'error' THEN -1 WHEN v > 50 THEN 1 ELSE 0 END AS p, label AS a FROM l JOIN p USING (sample_id) WHERE label IS NOT NULL)
        SELECT *, {_RATES} FROM (SELECT qc_mode, count(*) FILTER (p = 1 AND a = 1) AS TP, count(*) FILTER (p = 1 AND a = 0) AS FP, count(*) FILTER (p = 0 AND a = 1) AS FN, count(*) FILTER (p = 0 AND a = 0) AS TN,
          count(*) FILTER (p IN (0, 1)) AS total_labeled, count(*) FILTER (p NOT IN (0, 1)) AS invalid FROM j GROUP BY 1)""",
    "q_label_latest_wins": "SELECT event_id % 500 AS sample_id, arg_max((user_id % 2)::INT, event_id) AS label, count(*) AS writes FROM events GROUP BY 1",
}
