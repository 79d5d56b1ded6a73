"""Oracle SQL of the inferred turns: one recursive step per record."""

from __future__ import annotations

from ..fixtures import F1_SQL

# Children running and the roster's validity at every record.
_CHILDREN = """bx AS (SELECT * FROM tb WHERE NOT forked),
ce AS (SELECT session_id, ord, child_key, CASE WHEN child_event IN ('launch', 'resume') THEN 1 ELSE 0 END AS runs,
   max(CASE WHEN child_event = 'launch' THEN 1 ELSE 0 END) OVER w AS kn,
   coalesce(max(CASE WHEN child_event = 'launch' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id, child_key ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS kb
  FROM bx WHERE child_event IS NOT NULL AND NOT bad WINDOW w AS (PARTITION BY session_id, child_key ORDER BY ord)),
cd AS (SELECT session_id, ord, CASE WHEN kn = 1 THEN runs - CASE WHEN kb = 1 THEN lag(runs) OVER (PARTITION BY session_id, child_key ORDER BY ord) ELSE 0 END ELSE 0 END AS delta FROM ce),
br AS (SELECT bx.*, row_number() OVER w AS n, CAST(sum(coalesce(delta, 0)) OVER w AS BIGINT) AS crun,
   max(CASE WHEN mismatch OR (bad AND kind IN ('user', 'attachment')) THEN 1 ELSE 0 END) OVER w = 0 AS cok,
   CASE WHEN bad AND NOT synthetic THEN CASE WHEN kind = 'queue-operation' THEN 'queue' ELSE 'record' END END AS lost_kind
  FROM bx LEFT JOIN cd ON cd.session_id = bx.session_id AND cd.ord = bx.ord WINDOW w AS (PARTITION BY bx.session_id ORDER BY bx.ord))"""

# ph: 0 idle, 1 pending, 2 running, 3 unsure.
_STEP = """st AS (
 SELECT session_id, 0::BIGINT AS n, 0::BIGINT AS ord, 0 AS ph, NULL::VARCHAR AS ck, NULL::BIGINT AS cs, false AS cmd, NULL::BIGINT AS taken, false AS silent, false AS gap, false AS loc,
   false AS adj, false AS clean, false AS known, false AS seen, false AS fgn, []::VARCHAR[] AS fin, 0::BIGINT AS fl, false AS lost, 0::BIGINT AS turns, 0::BIGINT AS total,
   NULL::BIGINT AS ls, NULL::BIGINT AS le, NULL::VARCHAR AS lo, NULL::VARCHAR AS gate, NULL::BIGINT AS joined, true AS cok, 0::BIGINT AS crun
 FROM (SELECT DISTINCT session_id FROM br)
 UNION ALL
 SELECT session_id, n, ord,
  CASE WHEN act IN ('unsure') THEN 3 WHEN act IN ('local', 'abort', 'end', 'untimed') THEN 0 WHEN act = 'confirm' AND ph = 1 THEN 2 WHEN act = 'pend' THEN 1 ELSE ph END,
  CASE WHEN act = 'pend' THEN rkey WHEN act IN ('unsure', 'lose', 'untimed', 'local', 'abort', 'end') THEN NULL ELSE ck END,
  CASE WHEN act = 'pend' THEN sec WHEN act IN ('unsure', 'lose', 'untimed', 'local', 'abort', 'end') THEN NULL ELSE cs END,
  CASE WHEN act = 'pend' THEN rcmd WHEN act IN ('unsure', 'lose', 'untimed', 'local', 'abort', 'end', 'confirm') THEN false ELSE cmd END,
  CASE WHEN act = 'take' THEN greatest(coalesce(taken, 0), stamp) WHEN act IN ('none', 'idle') OR (act = 'confirm' AND NOT final_stop) THEN taken ELSE NULL END,
  CASE WHEN act = 'silent' OR (act = 'confirm' AND final_stop) THEN ph = 2 OR (ph = 1 AND act = 'confirm') WHEN act IN ('none', 'idle', 'take', 'confirm') THEN silent ELSE false END,
  CASE WHEN act IN ('unsure', 'pend') THEN false WHEN act = 'lose' THEN ph = 0 WHEN act = 'untimed' THEN true WHEN act IN ('abort', 'end') THEN un ELSE gap END,
  CASE WHEN act IN ('unsure', 'abort', 'join', 'pend', 'trig') THEN false WHEN act = 'local' THEN true WHEN act = 'end' THEN NOT ran ELSE loc END,
  CASE WHEN skip THEN adj WHEN role IN ('trigger', 'assistant', 'end') OR raises THEN false WHEN role = 'abort' THEN true ELSE adj END,
  CASE WHEN act IN ('unsure', 'lose', 'untimed', 'local', 'abort') THEN false WHEN act = 'end' THEN kept AND cok AND crun = 0 AND NOT background
    WHEN act = 'silent' OR (act = 'confirm' AND final_stop) THEN cl AND NOT (ph = 2 OR (ph = 1 AND act = 'confirm')) WHEN act IN ('pend', 'trig') THEN cl AND NOT injected
    WHEN NOT skip AND role = 'ignored' AND local_command THEN false ELSE cl END,
  CASE WHEN act IN ('unsure', 'lose', 'untimed') THEN false WHEN act = 'confirm' AND ph = 1 THEN true
    WHEN act = 'abort' THEN CASE WHEN un THEN false WHEN kept THEN true WHEN ran OR loc OR ph = 1 THEN false ELSE known END
    WHEN act = 'end' THEN CASE WHEN un THEN false WHEN kept THEN true WHEN ran OR ph = 1 OR NOT adj THEN false ELSE known END ELSE known END,
  seen OR (NOT skip AND (role IN ('trigger', 'end') OR (ph = 1 AND role IN ('assistant', 'abort')))) OR kept,
  fgn OR mismatch,
  CASE WHEN kept THEN list_append(fin, ck) ELSE fin END,
  CASE WHEN NOT skip AND (role IN ('abort', 'end') OR raises) THEN greatest(fl, coalesce(sec, 0)) ELSE fl END,
  lost OR act IN ('unsure', 'lose', 'untimed') OR (act = 'abort' AND (loc OR ran OR ph = 1 OR un)) OR (act = 'end' AND ((ran AND NOT kept) OR (NOT ran AND (ph = 1 OR NOT adj)) OR un)),
  turns + kept::INT, total + CASE WHEN kept THEN sec - cs ELSE 0 END, CASE WHEN kept THEN cs ELSE ls END, CASE WHEN kept THEN sec ELSE le END,
  CASE WHEN kept THEN CASE role WHEN 'abort' THEN 'aborted' ELSE 'completed' END ELSE lo END,
  CASE WHEN act = 'join' THEN 'join' WHEN act = 'abort' AND ran THEN CASE WHEN kept THEN 'abort.kept' ELSE 'abort.rejected' END
    WHEN act = 'end' AND ran THEN CASE WHEN elapsed_ms IS NULL THEN 'end.missing' WHEN kept THEN 'end.kept' ELSE 'end.rejected' END END,
  CASE WHEN act = 'join' THEN cs END, CASE WHEN fgn THEN pcok ELSE cok END, CASE WHEN fgn THEN pcrun ELSE crun END
 FROM (SELECT *, coalesce(CASE WHEN act = 'abort' THEN ran AND dated AND sec >= cs WHEN act = 'end' THEN ran AND elapsed_ms IS NOT NULL AND stamp >= elapsed_ms * 1000
      AND abs((stamp - elapsed_ms * 1000) // 1000000 - cs) <= 2 AND sec >= cs END, false) AS kept
  FROM (SELECT *, coalesce(ph = 2 OR (act = 'abort' AND ph = 1 AND NOT list_contains(fin, ck) AND cs >= fl), false) AS ran, cl AND cok AND crun = 0 AS dated
   FROM (SELECT *, fgn OR mismatch OR lost_kind IS NOT NULL AS skip, CASE WHEN fgn OR mismatch OR lost_kind IS NOT NULL THEN clean ELSE clean AND NOT masks END AS cl,
      CASE WHEN fgn THEN 'none' WHEN mismatch THEN CASE WHEN ph IN (1, 2) OR gap THEN 'unsure' ELSE 'lose' END
       WHEN lost_kind = 'queue' THEN CASE WHEN gap OR cmd THEN 'unsure' WHEN ph = 0 THEN 'untimed' ELSE 'none' END
       WHEN lost_kind IS NOT NULL THEN CASE WHEN ph IN (1, 2) OR gap THEN 'unsure' ELSE 'lose' END
       WHEN role = 'unknown' THEN 'unsure' WHEN role IN ('abort', 'end', 'silent') THEN role
       WHEN role = 'ignored' THEN CASE WHEN prompt AND (ph NOT IN (1, 2) OR silent) THEN 'unsure' WHEN cmd AND (local_output OR local_command) THEN CASE WHEN taken IS NOT NULL THEN 'unsure' ELSE 'local' END ELSE 'none' END
       WHEN role = 'queue' THEN CASE WHEN NOT take THEN 'none' WHEN ph IN (1, 2) AND NOT silent THEN CASE WHEN un AND cmd THEN 'unsure' WHEN un THEN 'none' ELSE 'take' END
         WHEN gap THEN 'unsure' WHEN un AND ph = 0 THEN 'untimed' ELSE 'idle' END
       WHEN role = 'assistant' THEN CASE WHEN ph = 0 AND (gap OR NOT adj) THEN 'unsure' WHEN ph = 1 AND (list_contains(fin, ck) OR cs < fl) THEN 'unsure' ELSE 'confirm' END
       WHEN role = 'trigger' THEN CASE WHEN (loc AND injected) OR rkey IS NULL OR un THEN 'unsure' WHEN coalesce(stamp <= taken, false) AND ph = 2 THEN 'join'
         WHEN ph IN (1, 2) OR gap OR sec < fl THEN 'unsure' WHEN ph = 0 THEN 'pend' ELSE 'trig' END ELSE 'none' END AS act,
      coalesce(NOT fgn AND NOT mismatch AND lost_kind IS NULL AND role = 'queue' AND take AND ph NOT IN (1, 2), false) AS raises
    FROM (SELECT r.session_id, r.n, r.ord, r.role, r.mismatch, r.lost_kind, r.key AS rkey, r.command AS rcmd, r.stamp, r.stamp // 1000000 AS sec, coalesce(r.stamp // 1000000, 0) = 0 AS un,
       r.injected, r.final_stop, r.local_output, r.local_command, r.prompt, r.take, r.elapsed_ms, r.background, r.masks, r.cok, r.crun, s.cok AS pcok, s.crun AS pcrun,
       s.ph, s.ck, s.cs, s.cmd, s.taken, s.silent, s.gap, s.loc, s.adj, s.clean, s.known, s.seen, s.fgn, s.fin, s.fl, s.lost, s.turns, s.total, s.ls, s.le, s.lo
     FROM st s JOIN br r ON r.session_id = s.session_id AND r.n = s.n + 1)))))"""


def fold_sql(trigger_sql: str, columns: dict[str, str]) -> str:
    cols = ", ".join(f"{e.format(div='//')} AS {n}" for n, e in columns.items())
    queued = "CASE WHEN p = 6 AND k % 5 = 2 AND trig > 0 THEN trig ELSE stamp END AS stamp"
    return (
        f"WITH RECURSIVE {F1_SQL},\n{trigger_sql},\n"
        f"tb AS (SELECT * REPLACE ({queued}), {cols} FROM tg),\n{_CHILDREN},\n{_STEP}"
    )


def summary_sql(trigger_sql: str, columns: dict[str, str]) -> str:
    return fold_sql(trigger_sql, columns) + """
SELECT session_id, CASE WHEN NOT fgn THEN turns END AS turns, CASE WHEN complete THEN total END AS total_s, complete, CASE WHEN knows THEN ph = 2 END AS active,
  CASE WHEN knows THEN cs END AS started_at_s, CASE WHEN NOT fgn THEN le - ls END AS last_duration_s, CASE WHEN NOT fgn THEN le END AS last_end_s, CASE WHEN NOT fgn THEN lo END AS last_outcome
FROM (SELECT *, NOT lost AND seen AND NOT silent AND NOT fgn AS complete, known AND clean AND cok AND crun = 0 AND NOT silent AND NOT gap AND NOT loc AND ph <> 1 AND NOT fgn AS knows
  FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY n DESC) AS q FROM st) WHERE q = 1)"""


def gates_sql(trigger_sql: str, columns: dict[str, str]) -> str:
    return fold_sql(trigger_sql, columns) + "\nSELECT gate, count(*) AS records FROM st WHERE gate IS NOT NULL GROUP BY 1"


def joins_sql(trigger_sql: str, columns: dict[str, str]) -> str:
    return fold_sql(trigger_sql, columns) + """
SELECT st.session_id, st.ord, joined AS turn_start_s, br.stamp // 1000000 AS trigger_s FROM st JOIN br ON br.session_id = st.session_id AND br.n = st.n WHERE joined IS NOT NULL"""
