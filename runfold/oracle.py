"""DuckDB SQL for each query of `runfold.queries`, derived from the tables on its own."""

from __future__ import annotations

from runfold.sources.journal import NOW, NOW_EVENTS

N, NE = f"TIMESTAMP '{NOW}'", f"TIMESTAMP '{NOW_EVENTS}'"
POLICY = "CASE o_orderpriority WHEN '1-URGENT' THEN 'ANY' WHEN '2-HIGH' THEN 'QUORUM(2)' WHEN '3-MEDIUM' THEN 'QUORUM(1)' ELSE 'ALL' END"
#: Derived relations and those that they need.
VIEWS = {
    "runs": ((), f"SELECT concat('R', o_orderkey) AS run_id, substr(o_orderpriority, 3) AS agent_name, concat('v', o_orderkey % 5) AS agent_version, CASE WHEN o_orderstatus = 'F' THEN 'COMPLETED' ELSE 'RUNNING' END AS status, o_orderkey % 5 AS version, CASE WHEN o_orderstatus = 'P' THEN o_orderdate + to_days((o_orderkey % 60)::INTEGER) END AS available_at, o_orderdate AS created_at, {POLICY} AS policy FROM orders"),
    "lines": ((), "SELECT *, concat('R', l_orderkey) AS run_id, concat('S1.', child) AS step_id, concat('T', l_orderkey, '.', child) AS task_id FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS child FROM lineitem)"),
    "tasks": (("lines",), "SELECT task_id, run_id, step_id, concat('tool', l_partkey % 4) AS task_type, CASE WHEN l_returnflag = 'A' THEN 'COMPLETED' WHEN l_returnflag = 'R' THEN 'DEAD_LETTER' WHEN l_linestatus = 'O' THEN 'PENDING' ELSE 'RUNNING' END AS status, l_linenumber::BIGINT AS priority, l_shipdate AS available_at, l_partkey % 3 + 1 AS attempt, 3 AS max_attempts, l_shipdate - to_minutes(l_quantity::INTEGER) AS created_at FROM lines"),
    "effects": (("lines",), "SELECT concat(run_id, ':', step_id, ':E1') AS effect_key, task_id, run_id, concat('tool', l_partkey % 4) AS effect_type, ['NONE', 'IDEMPOTENT_BY_KEY', 'QUERYABLE', 'UNRECONCILABLE'][l_partkey % 4 + 1] AS effect_class, ['PENDING', 'RUNNING', 'COMMITTED', 'FAILED', 'UNKNOWN'][l_suppkey % 5 + 1] AS status, l_shipdate AS created_at, l_shipdate + to_minutes(l_quantity::INTEGER) AS updated_at, ['COMMITTED', 'NOT_EXECUTED', 'STILL_UNKNOWN'][l_quantity::BIGINT % 3 + 1] AS answer FROM lines"),
    "leases": (("lines",), "SELECT task_id, run_id, concat('W', l_suppkey % 16) AS worker_id, l_linenumber::BIGINT + 1 AS fencing_token, l_shipdate + to_minutes(l_quantity::INTEGER) AS expires_at FROM lines WHERE l_returnflag = 'N' AND l_linestatus = 'F'"),
    "deliveries": (("lines",), "SELECT l_orderkey * 100 + child AS outbox_id, task_id, CASE WHEN l_returnflag <> 'N' THEN l_shipdate END AS published_at, CASE WHEN l_partkey % 2 = 0 THEN l_shipdate + to_minutes(l_quantity::INTEGER) END AS available_at, l_partkey % 4 AS attempts FROM lines"),
    "stream": ((), "SELECT concat('U', user_id) AS run_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, CASE event_type WHEN 'signup' THEN 'SIGNAL_WAIT_STARTED' WHEN 'click' THEN 'SIGNAL_RECEIVED' WHEN 'view' THEN 'TIMER_SET' WHEN 'purchase' THEN 'TIMER_FIRED' WHEN 'error' THEN 'TASK_FAILED' ELSE 'OTHER' END AS event_type, concat('S', event_id % 3) AS step_id, ts AS created_at, value, event_id FROM events"),
    "signals": ((), "SELECT concat('U', user_id) AS run_id, concat('G', event_id % 5000) AS signal_id, event_type AS name, ts AS created_at, event_id FROM events"),
    "log": (("lines",), f"""SELECT run_id, seq, event_type, step_id, happened + to_minutes(seq::INTEGER) AS created_at, attempt, final, policy, n_calls FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY k, child) AS seq FROM (
        SELECT concat('R', o_orderkey) AS run_id, o_orderdate AS happened, k, 0 AS child, [ 'RUN_STARTED', 'FAN_OUT_STARTED', NULL, NULL, 'RUN_COMPLETED'][k + 1] AS event_type, CASE WHEN k = 1 THEN 'S1' END AS step_id, NULL::BIGINT AS attempt, NULL::BOOLEAN AS final, CASE WHEN k = 1 THEN {POLICY} END AS policy, CASE WHEN k = 1 THEN coalesce(n_calls, 0) END AS n_calls
        FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n_calls FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey CROSS JOIN (VALUES (0), (1), (4)) AS t(k) WHERE k <> 4 OR o_orderstatus = 'F'
        UNION ALL SELECT run_id, l_shipdate, k, child, CASE WHEN k = 2 THEN 'TASK_CREATED' WHEN l_returnflag = 'A' THEN 'TASK_COMPLETED' WHEN l_returnflag = 'R' THEN 'TASK_FAILED' ELSE 'TASK_CLAIMED' END, step_id, l_partkey % 3 + 1, CASE WHEN k = 3 AND l_returnflag = 'R' THEN l_partkey % 4 <> 0 END, NULL, NULL
        FROM lines CROSS JOIN (VALUES (2), (3)) AS t(k) WHERE k = 2 OR l_returnflag <> 'N' OR l_linestatus = 'F'))"""),
    "openers": (("stream",), "SELECT run_id, max(seq) AS seq FROM stream WHERE event_type IN ('TIMER_SET', 'SIGNAL_WAIT_STARTED') GROUP BY 1"),
    "waits": (("stream", "openers"), "SELECT s.run_id, s.step_id, s.seq, CASE s.event_type WHEN 'TIMER_SET' THEN 'TIMER' ELSE 'SIGNAL' END AS kind, CASE WHEN s.event_type = 'TIMER_SET' THEN s.created_at + to_minutes(trunc(s.value)::INTEGER) ELSE TIMESTAMP '9999-12-31 23:59:59' END AS until FROM stream s JOIN openers o ON s.run_id = o.run_id AND s.seq = o.seq WHERE NOT EXISTS (FROM stream c WHERE c.run_id = s.run_id AND c.step_id = s.step_id AND c.seq > s.seq AND c.event_type IN ('TIMER_FIRED', 'SIGNAL_RECEIVED', 'SIGNAL_WAIT_TIMED_OUT'))"),
    "fan": (("log",), """SELECT f.run_id, f.step_id AS step, f.policy, f.n_calls AS n, count(o.ok) FILTER (o.ok) AS ok, count(o.ok) AS settled FROM (SELECT * FROM log WHERE event_type = 'FAN_OUT_STARTED') f LEFT JOIN
        (SELECT run_id, step_id, arg_max(event_type = 'TASK_COMPLETED', seq) AS ok FROM log WHERE seq % 7 > 1 AND (event_type = 'TASK_COMPLETED' OR (event_type = 'TASK_FAILED' AND final)) GROUP BY ALL) o ON o.run_id = f.run_id GROUP BY ALL"""),
    "tools": ((), "SELECT * FROM (VALUES ('tool0', 'NONE', false, 0), ('tool1', 'IDEMPOTENT_BY_KEY', true, 86400), ('tool2', 'QUERYABLE', true, 1000000000)) AS t(name, effect_class, reconcilable, key_ttl_seconds)"),
    "decisions": ((), "SELECT DISTINCT concat('U', user_id) AS run_id, ['CALL_TOOL', 'CALL_TOOL_PARALLEL', 'SLEEP', 'WAIT_FOR_SIGNAL', 'COMPLETE', 'FAIL', 'CANCEL', 'ERROR'][user_id % 8 + 1] AS kind, user_id % 4 AS n_calls, CASE WHEN user_id % 3 = 0 THEN 'QUORUM(2)' ELSE 'ALL' END AS policy FROM events WHERE user_id % 11 <> 0"),
}
QUORUM = "nullif(regexp_extract({p}, '^QUORUM\\(([0-9]+)', 1), '')::BIGINT"
KIND = "CASE WHEN {p} IN ('ALL', 'ANY') THEN {p} WHEN " + QUORUM + " > 0 THEN 'QUORUM' END"


def at(c: str, name: str | None = None) -> str:
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S.%f') AS {name or c}"


def kind(p: str) -> str:
    return KIND.replace("{p}", p)


def quorum(p: str) -> str:
    return QUORUM.replace("{p}", p)


def policy_error(p: str, n: str) -> str:
    return f"CASE WHEN {n} < 1 THEN 'no calls' WHEN {kind(p)} IS NULL THEN 'unknown policy' WHEN {kind(p)} = 'QUORUM' AND {quorum(p)} > {n} THEN 'quorum out of range' END"


def satisfied(p: str, n: str, ok: str, settled: str) -> str:
    return f"CASE {kind(p)} WHEN 'ALL' THEN {settled} >= {n} WHEN 'ANY' THEN {ok} >= 1 OR {settled} >= {n} WHEN 'QUORUM' THEN {ok} >= {quorum(p)} OR {n} - ({settled} - {ok}) < {quorum(p)} ELSE true END"


def legal(moves: dict[str, tuple[str, ...]], a: str = "a", b: str = "b") -> str:
    return "(" + " OR ".join(f"({a} = '{k}' AND {b} IN ({', '.join(repr(x) for x in v)}))" for k, v in moves.items()) + ")"


def pairs(names: tuple[str, ...], moves: dict[str, tuple[str, ...]]) -> str:
    values = ", ".join(f"('{n}')" for n in names)
    return f'SELECT a AS "from", b AS "to", {legal(moves)} AS legal FROM (VALUES {values}) AS x(a), (VALUES {values}) AS y(b)'


CLOCK = "CASE WHEN {s} >= 3600 THEN concat({s} // 3600, 'h', {s} % 3600 // 60, 'm', {s} % 60, 's') WHEN {s} >= 60 THEN concat({s} // 60, 'm', {s} % 60, 's') ELSE concat({s}, 's') END"


def clock(s: str) -> str:
    return CLOCK.replace("{s}", f"({s})")


def duration(s: str) -> str:
    return f"CASE WHEN {s} < 60 THEN {clock(s)} WHEN {s} < 172800 THEN {clock(f'({s} + 30) // 60 * 60')} ELSE concat({s} // 86400, 'd', {clock(f'({s} % 86400 + 1800) // 3600 * 3600')}) END"


RUN_MOVES = {"RUNNING": ("COMPLETED", "FAILED", "CANCELLED")}
TASK_MOVES = {"PENDING": ("RUNNING", "CANCELLED"), "RUNNING": ("COMPLETED", "FAILED", "CANCELLED", "DEAD_LETTER", "PENDING")}
EFFECT_MOVES = {"PENDING": ("RUNNING", "FAILED"), "RUNNING": ("COMMITTED", "FAILED", "UNKNOWN"), "FAILED": ("RUNNING",), "UNKNOWN": ("COMMITTED", "FAILED", "RUNNING", "UNKNOWN")}

#: name: (views, SQL)
SQL: dict[str, tuple[tuple[str, ...], str]] = {
    "fanout_join_verdict": (("runs",), f"SELECT run_id, policy, n, ok, settled, {policy_error('policy', 'n')} AS error, {satisfied('policy', 'n', 'ok', 'settled')} AS satisfied FROM (SELECT r.run_id, r.policy, count(l_orderkey) AS n, count(*) FILTER (l_returnflag = 'A') AS ok, count(*) FILTER (l_returnflag <> 'N') AS settled FROM runs r LEFT JOIN lineitem ON concat('R', l_orderkey) = run_id GROUP BY ALL)"),
    "run_by_id": (("runs",), "SELECT run_id, agent_name, agent_version, status, version FROM runs WHERE run_id = 'R42'"),
    "tasks_of_run": (("tasks",), f"SELECT task_id, step_id, status, {at('created_at')} FROM tasks WHERE run_id = 'R42'"),
    "history_of_run": (("log",), f"SELECT seq, event_type, step_id, {at('created_at')} FROM log WHERE run_id = 'R42'"),
    "effect_by_key": (("effects",), "SELECT effect_key, effect_class, status FROM effects WHERE effect_key = 'R42:S1.0:E1'"),
    "effects_of_run": (("effects",), f"SELECT effect_key, status, {at('created_at')} FROM effects WHERE run_id = 'R42'"),
    "lease_by_task": (("leases",), f"SELECT task_id, worker_id, fencing_token, {at('expires_at')} FROM leases WHERE starts_with(task_id, 'T42.')"),
    "signals_of_run": (("signals",), f"SELECT signal_id, {at('created_at')} FROM signals WHERE run_id = 'U7' AND name = 'click'"),
    "runs_awaiting_advance": (("runs", "tasks"), f"SELECT run_id, agent_name, agent_version FROM runs r WHERE status = 'RUNNING' AND (available_at IS NULL OR available_at <= {N}) AND NOT EXISTS (FROM tasks t WHERE t.run_id = r.run_id AND t.status IN ('PENDING', 'RUNNING'))"),
    "expired_leases": (("leases", "tasks"), f"SELECT l.task_id, worker_id, fencing_token, {at('expires_at')} FROM leases l JOIN tasks t ON l.task_id = t.task_id WHERE l.expires_at <= {N} AND t.status IN ('PENDING', 'RUNNING') ORDER BY l.expires_at, l.task_id LIMIT 500"),
    "unconsumed_signal": (("waits", "signals"), f"SELECT run_id, name, signal_id, {at('created_at')} FROM (SELECT s.*, row_number() OVER (PARTITION BY s.run_id, s.name ORDER BY s.created_at, s.signal_id) AS n FROM signals s JOIN waits w ON w.run_id = s.run_id AND w.kind = 'SIGNAL' WHERE s.name = 'click' AND NOT EXISTS (FROM events e WHERE e.event_type = 'click' AND e.event_id % 3 = 0 AND concat('U', e.user_id) = s.run_id AND concat('G', e.event_id % 5000) = s.signal_id)) WHERE n = 1"),
    "task_with_tool": (("tasks", "tools"), "SELECT task_type, effect_class, CASE WHEN name IS NULL THEN 'tool not found' END AS error, count(*) AS tasks FROM tasks LEFT JOIN tools ON name = task_type GROUP BY ALL"),
    "effect_with_tool": (("effects", "tools"), f"SELECT effect_type, reconcilable, status, count(*) AS effects FROM effects e JOIN tools t ON t.name = e.effect_type WHERE status IN ('RUNNING', 'UNKNOWN') AND updated_at < {N} GROUP BY ALL"),
    "decider_for_run": (("runs",), "WITH s AS (SELECT * FROM (VALUES ('s1', 'URGENT', 'v0'), ('s2', 'URGENT', 'v1'), ('s3', 'HIGH', 'v2')) AS t(session_id, a, v)) SELECT run_id, agent_name, agent_version, session_id, CASE WHEN session_id IS NOT NULL THEN 'OK' WHEN agent_name NOT IN (SELECT a FROM s) THEN 'NO_WORKER' ELSE 'WRONG_VERSION' END AS outcome FROM runs LEFT JOIN s ON a = agent_name AND v = agent_version WHERE status = 'RUNNING'"),
    "orphan_lines": (("tasks", "runs"), "SELECT run_id, count(*) AS tasks FROM tasks WHERE run_id NOT IN (SELECT run_id FROM runs WHERE created_at < TIMESTAMP '1999-01-01') GROUP BY 1"),
    "replay_mismatch": (("lines",), "SELECT run_id, step_id, concat('tool', l_partkey % 4) AS recorded, concat('tool', CASE WHEN l_partkey % 97 = 0 THEN 3 ELSE l_partkey % 4 END) AS replayed FROM lines WHERE (l_partkey % 97 = 0 AND l_partkey % 4 <> 3) OR l_suppkey % 89 = 0"),
    "next_seq": (("runs", "log"), "SELECT run_id, coalesce(max(seq), 0) + 1 AS next_seq FROM runs LEFT JOIN log USING (run_id) GROUP BY 1"),
    "next_wake_up": (("runs",), f"SELECT {at('min(available_at)', 'wake_at')} FROM runs WHERE status = 'RUNNING' AND available_at > {N}"),
    "scan_delay": (("runs",), f"SELECT greatest(50, least(2000, coalesce(date_sub('millisecond', {N}, min(available_at)), 2000)))::BIGINT AS delay_ms FROM runs WHERE status = 'RUNNING' AND available_at > {N}"),
    "next_token": (("leases",), "SELECT task_id, max(fencing_token) + 1 AS next_token FROM leases GROUP BY 1"),
    "delivery_attempts": (("deliveries",), "SELECT attempts + CASE WHEN outbox_id % 7 = 0 AND published_at IS NULL THEN 2 ELSE 0 END AS attempts, count(*) AS deliveries FROM deliveries GROUP BY 1"),
    "agent_versions": (("runs",), "SELECT agent_name, string_agg(DISTINCT agent_version, ',' ORDER BY agent_version) AS versions FROM runs GROUP BY 1"),
    "tool_class_conflicts": ((), "SELECT agent_name, name, count(DISTINCT c) AS classes, min(c) AS least, max(c) AS most FROM (SELECT (l_suppkey % 16)::VARCHAR AS agent_name, concat('tool', l_partkey % 6) AS name, CASE WHEN l_partkey % 211 = 0 THEN 'NONE' ELSE 'QUERYABLE' END AS c FROM lineitem) GROUP BY ALL HAVING count(DISTINCT c) > 1"),
    "tool_names": (("tasks",), "SELECT DISTINCT task_type FROM tasks"),
    "join_counts": (("fan",), "SELECT policy, sum(n)::BIGINT AS n, sum(ok)::BIGINT AS ok, sum(settled)::BIGINT AS settled FROM fan GROUP BY 1"),
    "consumed_signals": (("stream",), "SELECT DISTINCT run_id, concat('G', event_id % 500) AS signal_id FROM stream WHERE event_type = 'SIGNAL_RECEIVED' AND event_id % 11 <> 0"),
    "pending_wait": (("waits",), f"SELECT run_id, step_id, seq, kind, {at('until')} FROM waits"),
    "wait_description": (("waits",), f"SELECT run_id, concat(what, CASE WHEN until >= TIMESTAMP '9999-12-31 23:59:59' THEN ', with no scheduled wake-up' WHEN until <= {NE} THEN concat(u, ' (due ', {duration(f'''date_sub('second', until, {NE})''')}, ' ago)') ELSE concat(u, ' (in ', {duration(f'''date_sub('second', {NE}, until)''')}, ')') END) AS description FROM (SELECT *, concat(CASE kind WHEN 'TIMER' THEN 'sleeping' ELSE 'waiting for a signal' END, ' at step ', step_id) AS what, concat(' until ', strftime(until, '%Y-%m-%d %H:%M:%S')) AS u FROM waits)"),
    "pending_fanout": (("fan",), f"SELECT run_id, step, policy, n, ok, settled FROM fan WHERE NOT {satisfied('policy', 'n', 'ok', 'settled')}"),
    "history_steps": (('log',), """WITH l AS (SELECT run_id, step_id, event_type, final, CASE WHEN k % 11 = 3 THEN 1000 - seq ELSE seq END AS seq FROM (SELECT *, substr(run_id, 2)::BIGINT AS k FROM log WHERE event_type IN ('TASK_CREATED', 'TASK_COMPLETED', 'TASK_FAILED')) WHERE NOT (k % 13 = 5 AND event_type = 'TASK_CREATED')),
        steps AS (SELECT DISTINCT run_id, step_id FROM l WHERE event_type <> 'TASK_FAILED'),
        made AS (SELECT run_id, step_id, min(seq) AS first, max(seq) AS last FROM l WHERE event_type = 'TASK_CREATED' GROUP BY ALL),
        s AS (SELECT s.*, coalesce(first, 100000) AS first, coalesce(last, -1) AS last FROM steps s LEFT JOIN made m ON m.run_id = s.run_id AND m.step_id = s.step_id),
        told AS (SELECT s.run_id, s.step_id, coalesce(bool_or(event_type = 'TASK_COMPLETED' AND seq > last), false) AS done, coalesce(bool_or(event_type = 'TASK_FAILED' AND final AND seq > last), false) AS lost, coalesce(bool_or(event_type = 'TASK_COMPLETED' AND seq < first), false) AS early FROM s JOIN l ON l.run_id = s.run_id AND l.step_id = s.step_id GROUP BY ALL)
        SELECT run_id, CASE WHEN done THEN 'COMPLETED' WHEN lost THEN 'FAILED' ELSE 'DECIDED' END AS state, CASE WHEN early THEN 'completion without creation' END AS error, count(*) AS steps FROM told GROUP BY ALL"""),
    "history_waits": (('stream',), """WITH w AS (SELECT run_id, step_id, seq, event_type, event_type IN ('TIMER_SET', 'SIGNAL_WAIT_STARTED') AS opens FROM stream WHERE event_type IN ('TIMER_SET', 'SIGNAL_WAIT_STARTED', 'TIMER_FIRED', 'SIGNAL_RECEIVED')),
        last AS (SELECT *, row_number() OVER (PARTITION BY run_id, step_id ORDER BY seq DESC) AS n, row_number() OVER (PARTITION BY run_id, step_id ORDER BY seq) AS m, bool_or(opens) OVER (PARTITION BY run_id, step_id) AS ever FROM w)
        SELECT run_id, step_id, CASE WHEN any_value(ever) THEN CASE WHEN bool_or(opens) FILTER (n = 1) THEN 'OPEN' ELSE 'RESOLVED' END END AS state, CASE WHEN NOT bool_or(opens) FILTER (m = 1) THEN 'resolution without wait' END AS error FROM last GROUP BY ALL"""),
    "static_decider": ((), "SELECT concat('C', conv_id) AS run_id, CASE WHEN n >= 2 THEN 'COMPLETE' ELSE 'CALL_TOOL' END AS decision, CASE WHEN n < 2 THEN concat('S', n + 1) END AS next_step, CASE WHEN n >= 2 THEN md5(last) END AS output FROM (SELECT conv_id, count(*) FILTER (role = 'assistant') AS n, arg_max(text, turn) FILTER (role = 'assistant') AS last FROM conversations GROUP BY 1)"),
    "run_clock": (("stream",), f"SELECT run_id, {at('created_at', 'started_at')} FROM stream WHERE seq = 1"),
    "seq_gaps": (("stream",), "SELECT run_id, seq, p AS previous FROM (SELECT run_id, seq, coalesce(lag(seq) OVER (PARTITION BY run_id ORDER BY seq), 0) AS p FROM stream WHERE event_id % 13 <> 0) WHERE seq <> p + 1"),
    "pending_tasks_topk": (("tasks",), f"SELECT task_id, priority, {at('created_at')} FROM tasks WHERE status = 'PENDING' AND available_at <= {N} ORDER BY priority DESC, tasks.created_at, task_id LIMIT 100"),
    "task_assignment": (("tasks", "leases"), f"SELECT task_id, worker_id, {at(f'{N} + INTERVAL 1 MINUTE', 'visible_at')} FROM (SELECT task_id, row_number() OVER (ORDER BY priority DESC, available_at, created_at, task_id) AS n FROM tasks WHERE status = 'PENDING' AND available_at <= {N}) JOIN (SELECT worker_id, row_number() OVER (ORDER BY worker_id) AS n FROM (SELECT DISTINCT worker_id FROM leases)) USING (n)"),
    "pending_deliveries": (("deliveries",), f"SELECT outbox_id, task_id FROM deliveries WHERE published_at IS NULL AND (available_at IS NULL OR available_at <= {N}) ORDER BY outbox_id LIMIT 100"),
    "unresolved_effects": (("effects",), f"SELECT effect_key, status, {at('updated_at')} FROM effects WHERE status IN ('RUNNING', 'UNKNOWN') AND effects.updated_at < {N} ORDER BY effects.updated_at, effect_key LIMIT 50"),
    "round_robin": (("tasks",), "SELECT worker, task_type, count(*) AS calls FROM (SELECT task_type, (row_number() OVER (PARTITION BY run_id ORDER BY task_id) - 1) % 3 AS worker FROM tasks) GROUP BY ALL"),
    "migrations_pending": (("runs",), "SELECT DISTINCT agent_version FROM runs EXCEPT SELECT agent_version FROM runs WHERE year(created_at) = 1997 AND agent_version IN ('v1', 'v3')"),
    "mark_delivered": (("deliveries",), f"SELECT p IS NULL AS waiting, count(*) AS deliveries, count(*) FILTER (p = {N}) AS marked FROM (SELECT coalesce(published_at, CASE WHEN outbox_id % 5 = 0 THEN {N} END) AS p FROM deliveries) GROUP BY 1"),
    "tool_union": (("tools",), "SELECT name, effect_class FROM tools UNION ALL SELECT 'tool9', 'NONE'"),
    "step_parent_index": (("lines",), r"SELECT nullif(regexp_extract(s, '^(.+)\.([+-]?[0-9]+)$', 1), '') AS parent, coalesce(nullif(regexp_extract(s, '^(.+)\.([+-]?[0-9]+)$', 2), '')::BIGINT, -1) AS child_index, count(*) AS steps FROM (SELECT CASE l_linenumber WHEN 1 THEN concat(step_id, '.7') WHEN 2 THEN 'S12' WHEN 3 THEN 'S1.x' ELSE step_id END AS s FROM lines) GROUP BY ALL"),
    "children_names": ((), "SELECT array_to_string(list_transform(range(n), lambda i: concat('S1.', i)), ',') AS children, count(*) AS runs FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey) GROUP BY ALL"),
    "idempotency_key": (("lines",), "SELECT task_id, concat(run_id, ':', step_id, ':E1') AS idempotency_key FROM lines"),
    "join_policy_valid": (("fan",), f"SELECT run_id, p AS policy, {kind('p')} AS kind, {quorum('p')} AS quorum, {policy_error('p', 'n')} AS error, CASE WHEN {kind('p')} = 'QUORUM' THEN concat('QUORUM(', {quorum('p')}, ')') ELSE {kind('p')} END AS canonical FROM (SELECT *, CASE WHEN n = 5 THEN 'MAJORITY' ELSE policy END AS p FROM fan)"),
    "failure_class": ((), "SELECT CASE WHEN l_returnflag = 'A' THEN 'COMMITTED' WHEN l_linestatus = 'O' THEN 'FAILED' ELSE 'UNKNOWN' END AS effect_status, count(*) AS calls FROM lineitem GROUP BY 1"),
    "recovery_action": (("tasks", "effects"), "SELECT t.task_id, CASE WHEN e.status IS NULL OR e.status IN ('PENDING', 'FAILED') THEN 'EXECUTE' WHEN e.status = 'COMMITTED' THEN 'COMPLETE' WHEN e.effect_class IN ('IDEMPOTENT_BY_KEY', 'QUERYABLE') THEN 'RECONCILE' ELSE 'ESCALATE' END AS action FROM tasks t LEFT JOIN (FROM effects WHERE NOT ends_with(task_id, '9')) e ON e.task_id = t.task_id WHERE t.status = 'RUNNING'"),
    "backoff_schedule": (("tasks",), "SELECT attempt, least(15.0::DOUBLE, 2.0::DOUBLE * power(3.0::DOUBLE, attempt - 1)) AS delay_seconds, count(*) AS tasks FROM tasks GROUP BY ALL"),
    "run_transition_legal": ((), pairs(("RUNNING", "COMPLETED", "FAILED", "CANCELLED"), RUN_MOVES)),
    "task_transition_legal": ((), pairs(("PENDING", "RUNNING", "COMPLETED", "FAILED", "CANCELLED", "DEAD_LETTER"), TASK_MOVES)),
    "effect_transition_legal": ((), pairs(("PENDING", "RUNNING", "COMMITTED", "FAILED", "UNKNOWN"), EFFECT_MOVES)),
    "status_predicates": (("effects",), "SELECT DISTINCT status, effect_class, status IN ('COMMITTED', 'FAILED') AS resolved, effect_class <> 'NONE' AS consequence, effect_class IN ('IDEMPOTENT_BY_KEY', 'QUERYABLE') AS auto_resolves FROM effects"),
    "run_predicates": (("runs",), f"SELECT status <> 'RUNNING' AS terminal, coalesce(available_at > {N}, false) AS waiting, count(*) AS runs FROM runs GROUP BY ALL"),
    "task_predicates": (("tasks",), "SELECT status NOT IN ('PENDING', 'RUNNING') AS terminal, attempt >= max_attempts AS exhausted, true AS valid, count(*) AS tasks FROM tasks GROUP BY ALL"),
    "key_expired": (("lines",), f"SELECT expired, count(*) AS effects, min(task_id) AS least, max(task_id) AS most FROM (SELECT task_id, ttl > 0 AND date_diff('microsecond', l_shipdate, {N}) > ttl * 1000000 AS expired FROM (SELECT *, l_quantity::BIGINT * 86400 * 20 - 86400 AS ttl FROM lines)) GROUP BY 1"),
    "external_reference": ((), "SELECT event_id, CASE event_type WHEN 'click' THEN concat('X', event_id) WHEN 'view' THEN NULL WHEN 'error' THEN NULL ELSE concat('Q', event_id % 10) END AS reference FROM events"),
    "envelope_decode": ((), "SELECT event_id, CASE WHEN event_id % 4 <> 0 AND event_id % 7 <> 0 THEN (props::JSON ->> 'k')::BIGINT END AS k, CASE WHEN event_id % 4 = 0 THEN 'unknown version' WHEN event_id % 7 = 0 THEN 'undecodable' END AS error FROM events"),
    "delivery_decode": ((), "SELECT event_id, CASE WHEN event_id % 5 <> 0 AND event_id % 7 <> 0 THEN concat('T', event_id) END AS task_id, CASE WHEN event_id % 5 = 0 THEN 'no task' WHEN event_id % 7 = 0 THEN 'unknown version' END AS error FROM events"),
    "signal_request": ((), "SELECT CASE WHEN event_id % 1000 * 1500 > 1048576 THEN 413 WHEN event_id % 17 = 0 THEN 400 WHEN user_id % 10 = 4 THEN 404 WHEN user_id % 9 = 0 THEN 409 ELSE 202 END::BIGINT AS code, count(*) AS requests FROM events GROUP BY 1"),
    "duration_text": ((), f"SELECT event_id, {duration('s')} AS text FROM (SELECT event_id, event_id * event_id % 400000 AS s FROM events)"),
    "signal_dedup": (("signals",), "SELECT event_id, CASE WHEN u % 7 = 3 THEN 'NOT_FOUND' WHEN u % 5 = 0 THEN 'TERMINAL' WHEN n > 1 THEN 'DUPLICATE' ELSE 'STORED' END AS outcome FROM (SELECT event_id, substr(run_id, 2)::BIGINT AS u, row_number() OVER (PARTITION BY run_id, signal_id ORDER BY created_at, event_id) AS n FROM signals)"),
    "task_claim_dedup": (('tasks',), f"""WITH RECURSIVE m AS (SELECT * FROM (VALUES (0, 'PENDING', 'RUNNING'), (1, 'RUNNING', NULL), (2, 'PENDING', 'RUNNING'), (3, 'RUNNING', 'RUNNING')) AS t(d, a, b)),
        f AS (SELECT task_id, priority, -1 AS d, status, attempt, NULL::VARCHAR AS b, NULL::VARCHAR AS outcome FROM tasks
        UNION ALL SELECT task_id, priority, d, CASE WHEN outcome = 'OK' THEN b ELSE status END, attempt + CASE WHEN outcome = 'OK' AND b = 'RUNNING' THEN 1 ELSE 0 END, b, outcome FROM (SELECT *, CASE WHEN status <> a THEN 'CONFLICT' WHEN NOT {legal(TASK_MOVES)} THEN 'ILLEGAL' ELSE 'OK' END AS outcome FROM (SELECT f.task_id, f.priority, m.d, f.status, f.attempt, m.a, coalesce(m.b, ['COMPLETED', 'PENDING', 'DEAD_LETTER'][f.priority % 3 + 1]) AS b FROM f JOIN m ON m.d = f.d + 1)))
        SELECT d AS delivery, b AS "to", outcome, attempt, count(*) AS claims FROM f WHERE d >= 0 GROUP BY ALL"""),
    "run_version_cas": (('lines', 'runs'), """WITH RECURSIVE c AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY child, task_id) AS n FROM (SELECT concat('R', l_orderkey + CASE WHEN l_partkey % 50 = 0 THEN 1000000000 ELSE 0 END) AS rid, task_id, child, l_orderkey % 5 + child - l_suppkey % 2 AS expected, CASE WHEN l_partkey % 5 = 0 THEN 'COMPLETED' ELSE 'RUNNING' END AS next FROM lines)),
        f AS (SELECT rid, 0::BIGINT AS n, any_value(status) AS status, any_value(version) AS version, NULL::VARCHAR AS next, NULL::VARCHAR AS outcome FROM c LEFT JOIN runs ON run_id = rid GROUP BY rid
        UNION ALL SELECT rid, n, CASE WHEN outcome = 'OK' THEN next ELSE status END, version + CASE WHEN outcome = 'OK' THEN 1 ELSE 0 END, next, outcome FROM (SELECT f.rid, c.n, f.status, f.version, c.next, CASE WHEN f.version IS NULL THEN 'NOT_FOUND' WHEN f.version <> c.expected THEN 'CONFLICT' WHEN c.next <> f.status AND NOT (f.status = 'RUNNING' AND c.next IN ('COMPLETED', 'FAILED', 'CANCELLED')) THEN 'ILLEGAL' ELSE 'OK' END AS outcome FROM f JOIN c ON c.rid = f.rid AND c.n = f.n + 1))
        SELECT outcome, next, CASE WHEN outcome = 'OK' THEN version END AS new_version, count(*) AS commands FROM f WHERE n > 0 GROUP BY ALL"""),
    "fenced_writes": (("lines", "leases"), "SELECT CASE WHEN fencing_token IS NULL THEN 'NOT_FOUND' WHEN fencing_token = l_suppkey % 8 + 1 THEN 'OK' ELSE 'FENCED' END AS outcome, count(*) AS writes FROM lines LEFT JOIN leases USING (task_id) GROUP BY 1"),
    "lease_acquire": (("lines", "leases"), f"SELECT CASE WHEN ok THEN 'OK' ELSE 'LEASE_HELD' END AS outcome, CASE WHEN ok THEN coalesce(fencing_token, 0) + 1 END AS token, w AS worker_id, count(*) AS leases FROM (SELECT fencing_token, w, (expires_at IS NULL OR expires_at <= {N}) AND w = 'W1' AS ok FROM lines LEFT JOIN leases USING (task_id), (VALUES ('W1'), ('W2')) AS t(w)) GROUP BY ALL"),
    "effect_reserve": (("lines",), "SELECT CASE WHEN n = 1 THEN 'OK' ELSE 'CONFLICT' END AS outcome, count(*) AS effects FROM (SELECT row_number() OVER (PARTITION BY l_orderkey, child % 3 ORDER BY task_id) AS n FROM lines) GROUP BY 1"),
    "event_append": (("stream",), "SELECT CASE WHEN n = 1 AND (s > 4 OR s < 1) THEN 'OK' ELSE 'CONFLICT' END AS outcome, count(*) AS appends FROM (SELECT seq - seq % 2 AS s, row_number() OVER (PARTITION BY run_id, seq - seq % 2 ORDER BY event_id) AS n FROM stream) GROUP BY 1"),
    "worker_upsert": (("leases",), f"SELECT worker_id, task_id, {at('expires_at')} FROM (SELECT *, row_number() OVER (PARTITION BY worker_id ORDER BY expires_at DESC, task_id DESC) AS n FROM leases) WHERE n = 1"),
    "effect_resolve": (('lines', 'effects'), """WITH RECURSIVE f AS (SELECT task_id, l_partkey, -1 AS n, e.status, NULL::VARCHAR AS verdict, NULL::VARCHAR AS outcome FROM lines JOIN effects e USING (task_id)
        UNION ALL SELECT task_id, l_partkey, n, CASE WHEN outcome = 'OK' THEN verdict ELSE status END, verdict, outcome FROM (SELECT *, CASE WHEN status NOT IN ('RUNNING', 'UNKNOWN') THEN 'NOT_OPEN' WHEN verdict = 'COMMITTED' AND (l_partkey + n) % 3 <> 0 THEN 'REF_NEEDED' ELSE 'OK' END AS outcome FROM (SELECT task_id, l_partkey, n + 1 AS n, status, CASE WHEN (l_partkey + n + 1) % 2 = 0 THEN 'COMMITTED' ELSE 'FAILED' END AS verdict FROM f WHERE n < 1)))
        SELECT n, outcome, CASE WHEN outcome = 'OK' THEN verdict END AS new_status, count(*) AS effects FROM f WHERE n >= 0 GROUP BY ALL"""),
    "advance_plan": (("waits", "signals", "decisions"), f"""WITH r AS (SELECT DISTINCT concat('U', user_id) AS run_id, user_id % 13 = 0 AS terminal, user_id % 2 = 0 AS parked FROM events),
        w AS (SELECT run_id, kind, CASE WHEN kind = 'SIGNAL' AND seq % 2 = 0 THEN TIMESTAMP '2024-01-02' ELSE until END AS until FROM waits WHERE step_id <> 'S2'),
        g AS (SELECT DISTINCT run_id FROM signals WHERE name = 'click' AND event_id % 40 = 0)
        SELECT r.run_id, CASE WHEN terminal THEN 'NONE' WHEN w.kind = 'TIMER' AND until <= TIMESTAMP '2024-01-30 12:00:00' THEN 'TIMER_FIRED' WHEN w.kind = 'SIGNAL' AND g.run_id IS NOT NULL THEN 'SIGNAL_RECEIVED' WHEN w.kind = 'SIGNAL' AND until <= TIMESTAMP '2024-01-30 12:00:00' THEN 'SIGNAL_WAIT_TIMED_OUT' WHEN w.kind IS NOT NULL AND NOT parked THEN 'REPARK' WHEN w.kind IS NOT NULL THEN 'NONE' WHEN ends_with(r.run_id, '7') THEN 'NONE' WHEN d.kind IS NULL THEN 'RETRY_LATER'
        WHEN d.kind = 'CALL_TOOL_PARALLEL' THEN CASE WHEN {policy_error('d.policy', 'd.n_calls')} IS NOT NULL THEN 'RUN_FAILED' ELSE 'FAN_OUT_STARTED' END
        ELSE MAP {{'ERROR': 'RUN_FAILED', 'CALL_TOOL': 'TASK_CREATED', 'SLEEP': 'TIMER_SET', 'WAIT_FOR_SIGNAL': 'SIGNAL_WAIT_STARTED', 'COMPLETE': 'RUN_COMPLETED', 'FAIL': 'RUN_FAILED', 'CANCEL': 'RUN_CANCELLED'}}[d.kind] END AS action
        FROM r LEFT JOIN w USING (run_id) LEFT JOIN g USING (run_id) LEFT JOIN decisions d USING (run_id)"""),
    "dispatch_rows": (("decisions",), "SELECT run_id, step_id, concat(run_id, '/', step_id) AS task_id, 'PENDING' AS status FROM (SELECT run_id, 'S3' AS step_id FROM decisions WHERE kind = 'CALL_TOOL' UNION ALL SELECT run_id, concat('S3.', unnest(range(n_calls))) FROM decisions WHERE kind = 'CALL_TOOL_PARALLEL')"),
    "task_failure_plan": (("lines",), """SELECT CASE WHEN NOT cur THEN 'UNCHANGED' WHEN done THEN 'DEAD_LETTER' ELSE 'PENDING' END AS task, CASE WHEN NOT cur THEN '' WHEN done THEN 'TASK_FAILED(final),TASK_DEAD_LETTERED' ELSE 'TASK_FAILED,TASK_RETRY_SCHEDULED' END AS events,
        CASE WHEN NOT cur OR NOT done THEN 'UNCHANGED' WHEN esc THEN 'FAILED' WHEN l_linenumber <> 1 THEN 'ADVANCE' ELSE 'FAILED' END AS run, count(*) AS tasks FROM (SELECT l_linenumber, l_suppkey % 6 <> 0 AS cur, l_partkey % 7 = 0 AS esc, l_partkey % 3 = 2 OR l_partkey % 7 = 0 AS done FROM lines) GROUP BY ALL"""),
    "reaper_plan": (("leases", "tasks"), f"SELECT l.task_id, CASE WHEN attempt >= 3 THEN 'DEAD_LETTER' ELSE 'PENDING' END AS task, CASE WHEN attempt >= 3 THEN 'LEASE_EXPIRED,TASK_DEAD_LETTERED' ELSE 'LEASE_EXPIRED,TASK_RETRY_SCHEDULED' END AS events, fencing_token + 1 AS token FROM leases l JOIN tasks t USING (task_id) WHERE l.expires_at <= {N} AND t.status = 'RUNNING'"),
    "reconcile_live": (("effects",), f"SELECT CASE WHEN date_diff('microsecond', created_at, {N}) > 86400 * 700 * 1000000::BIGINT THEN 'ESCALATE' WHEN effect_class = 'IDEMPOTENT_BY_KEY' THEN 'PERFORM' WHEN effect_class = 'QUERYABLE' THEN CASE answer WHEN 'COMMITTED' THEN 'EFFECT_RECONCILED' WHEN 'NOT_EXECUTED' THEN 'PERFORM' ELSE 'STAY_UNKNOWN' END ELSE 'ESCALATE' END AS action, count(*) AS effects FROM effects WHERE status IN ('RUNNING', 'UNKNOWN') GROUP BY 1"),
    "reconcile_background": (("effects", "tools"), f"SELECT status AS before, CASE WHEN reconcilable IS NULL THEN status WHEN NOT reconcilable OR (key_ttl_seconds > 0 AND date_diff('microsecond', created_at, {N}) > key_ttl_seconds * 1000000::BIGINT) THEN 'UNKNOWN' WHEN answer = 'COMMITTED' THEN 'COMMITTED' WHEN answer = 'NOT_EXECUTED' THEN 'FAILED' ELSE 'UNKNOWN' END AS after, count(*) AS effects FROM effects e LEFT JOIN tools t ON t.name = e.effect_type WHERE status IN ('RUNNING', 'UNKNOWN') AND updated_at < {N} GROUP BY ALL"),
    "duplicate_commits": (("lines",), "SELECT concat(run_id, ':S1.', child % 4, ':E1') AS effect_key, count(*) AS commits FROM lines WHERE l_suppkey % 5 = 2 GROUP BY 1 HAVING count(*) > 1"),
    "live_leases": (("leases",), f"SELECT task_id, 2 AS leases FROM leases WHERE expires_at > {N} AND fencing_token > 5"),
    "stuck_runs": (("runs", "tasks"), "SELECT r.run_id, count(*) FILTER (t.status = 'DEAD_LETTER') AS dead FROM runs r JOIN tasks t USING (run_id) WHERE r.status = 'RUNNING' GROUP BY 1 HAVING dead > 0 AND count(*) FILTER (t.status IN ('PENDING', 'RUNNING')) = 0"),
    "claimed_before_not_before": (("tasks", "deliveries"), f"SELECT task_id, {at('t.available_at', 'available_at')}, {at('d.available_at', 'not_before')} FROM tasks t JOIN deliveries d USING (task_id) WHERE t.status = 'PENDING' AND d.published_at IS NULL AND d.available_at > t.available_at"),
    "unresolved_unknown": (("effects",), "SELECT effect_key, effect_class FROM effects WHERE status = 'UNKNOWN' AND effect_class IN ('NONE', 'UNRECONCILABLE')"),
    "dispatch_latency": (('log',), "SELECT date_diff('second', a, b) AS seconds, count(*) AS steps FROM (SELECT s.run_id, s.step_id, s.a, min(l.created_at) AS b FROM (SELECT run_id, step_id, min(created_at) AS a FROM log WHERE event_type = 'TASK_CREATED' GROUP BY ALL) s JOIN log l ON l.run_id = s.run_id AND l.step_id = s.step_id AND l.event_type = 'TASK_CLAIMED' AND l.created_at >= s.a GROUP BY ALL) GROUP BY 1"),
    "run_latency": (("log",), "SELECT date_sub('second', a, b) // 60 AS minutes, count(*) AS runs FROM (SELECT min(created_at) FILTER (event_type = 'RUN_STARTED') AS a, min(created_at) FILTER (event_type = 'RUN_COMPLETED') AS b FROM log GROUP BY run_id) WHERE b >= a GROUP BY 1"),
    "decision_validity": ((), f"SELECT event_id, kind, CASE kind WHEN 'CALL_TOOL' THEN CASE WHEN event_id % 4 = 0 THEN 'no tool' END WHEN 'CALL_TOOL_PARALLEL' THEN {policy_error('p', 'event_id % 4')} WHEN 'SLEEP' THEN CASE WHEN event_id % 5 = 2 THEN 'no instant' END WHEN 'WAIT_FOR_SIGNAL' THEN CASE WHEN event_id % 7 = 3 THEN 'no signal' END WHEN 'COMPLETE' THEN NULL ELSE 'unknown kind' END AS error FROM (SELECT event_id, ['CALL_TOOL', 'CALL_TOOL_PARALLEL', 'SLEEP', 'WAIT_FOR_SIGNAL', 'COMPLETE', 'COMPENSATE'][event_id % 6 + 1] AS kind, CASE WHEN event_id % 9 = 1 THEN 'SOME' ELSE 'QUORUM(2)' END AS p FROM events)"),
    "descriptor_validity": ((), "SELECT p_partkey, CASE WHEN p_partkey % 10 = 0 THEN 'no name' WHEN p_partkey % 3 = 2 THEN 'unspecified class' WHEN p_partkey % 3 = 0 AND p_size % 2 <> 0 THEN 'no reconciler' END AS error FROM part"),
    "provider_resolution": (("lines",), "SELECT CASE WHEN l_partkey % 5 = 0 OR l_quantity::BIGINT % 3 = 2 THEN 'STILL_UNKNOWN' WHEN l_quantity::BIGINT % 3 = 0 THEN 'COMMITTED' ELSE 'NOT_EXECUTED' END AS resolution, CASE WHEN l_suppkey % 3 = 0 THEN 'STILL_UNKNOWN' WHEN l_suppkey % 2 = 0 THEN 'COMMITTED' ELSE 'NOT_EXECUTED' END AS hook, count(*) AS effects FROM lines GROUP BY ALL"),
    "suspension_predicates": (("decisions",), "SELECT run_id, kind IN ('SLEEP', 'WAIT_FOR_SIGNAL') AS suspends, kind = 'WAIT_FOR_SIGNAL' AS indefinite FROM decisions"),
    "run_release": (("runs",), "SELECT available_at IS NULL OR run_id IN (SELECT concat('R', l_orderkey) FROM lineitem WHERE l_partkey % 10 = 0) AS ready, version, count(*) AS runs FROM runs WHERE status = 'RUNNING' GROUP BY ALL"),
    "run_finish": (("decisions",), "SELECT run_id, s AS status, concat('RUN_', s) AS event, kind = 'FAIL' AS keeps_reason FROM (SELECT *, CASE kind WHEN 'COMPLETE' THEN 'COMPLETED' WHEN 'FAIL' THEN 'FAILED' WHEN 'CANCEL' THEN 'CANCELLED' END AS s FROM decisions) WHERE s IS NOT NULL"),
    "task_complete": (('lines', 'tasks', 'leases'), """WITH RECURSIVE f AS (SELECT task_id, l_linenumber, l_partkey, fencing_token, -1 AS n, t.status, NULL::VARCHAR AS outcome FROM lines JOIN tasks t USING (task_id) LEFT JOIN leases USING (task_id)
        UNION ALL SELECT task_id, l_linenumber, l_partkey, fencing_token, n, CASE WHEN outcome = 'OK' THEN 'COMPLETED' ELSE status END, outcome FROM (SELECT *, CASE WHEN fencing_token IS NULL OR fencing_token <> l_linenumber + CASE WHEN n = 0 AND l_partkey % 3 = 0 THEN 2 ELSE 1 END THEN 'STALE' WHEN status <> 'RUNNING' THEN 'CONFLICT' ELSE 'OK' END AS outcome FROM (SELECT task_id, l_linenumber, l_partkey, fencing_token, n + 1 AS n, status FROM f WHERE n < 1)))
        SELECT n, outcome, count(*) AS reports FROM f WHERE n >= 0 GROUP BY ALL"""),
    "effect_update": (('effects',), f"""WITH RECURSIVE m AS (SELECT * FROM (VALUES (0, 'PENDING', 'RUNNING'), (1, 'RUNNING', NULL), (2, 'UNKNOWN', 'COMMITTED'), (3, 'COMMITTED', 'RUNNING')) AS t(n, a, b)),
        f AS (SELECT effect_key, answer, effect_class, -1 AS n, status, NULL::VARCHAR AS a, NULL::VARCHAR AS b, NULL::VARCHAR AS outcome, false AS told FROM effects
        UNION ALL SELECT effect_key, answer, effect_class, n, CASE WHEN outcome = 'OK' THEN b ELSE status END, a, b, outcome, told OR (outcome = 'OK' AND n = 1) FROM (SELECT *, CASE WHEN status <> a THEN 'CONFLICT' WHEN NOT {legal(EFFECT_MOVES)} THEN 'ILLEGAL' ELSE 'OK' END AS outcome FROM (SELECT f.effect_key, f.answer, f.effect_class, m.n, f.status, f.told, m.a, coalesce(m.b, CASE f.answer WHEN 'COMMITTED' THEN 'COMMITTED' WHEN 'NOT_EXECUTED' THEN 'FAILED' ELSE 'UNKNOWN' END) AS b FROM f JOIN m ON m.n = f.n + 1 WHERE effect_class <> 'NONE')))
        SELECT status, CASE WHEN told THEN 'seen' ELSE answer END AS answer, count(*) AS effects FROM f WHERE n = CASE WHEN effect_class <> 'NONE' THEN 3 ELSE -1 END GROUP BY ALL"""),
    "effect_status_from_log": (("effects",), "SELECT CASE WHEN status IN ('PENDING', 'RUNNING') THEN 'PENDING_OR_RUNNING' ELSE status END AS status, count(*) AS effects FROM effects GROUP BY 1"),
    "heartbeat_sessions": ((), f"SELECT worker_id, {at('min(ts)', 'first')}, {at('max(ts) + INTERVAL 6 HOUR', 'free_at')}, count(*) AS beats FROM (SELECT *, sum(new) OVER (PARTITION BY worker_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS n FROM (SELECT concat('W', user_id) AS worker_id, ts, event_id, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events)) GROUP BY worker_id, n"),
    "retention": ((), f"SELECT event_type, count(*) AS kept FROM events WHERE ts > {NE} - INTERVAL 1 DAY AND ts <= {NE} GROUP BY 1"),
    "canonical_json": ((), "SELECT event_id, concat('{\"a\":{\"k\":', props::JSON ->> 'k', '},\"z\":1.0}') AS canonical FROM events"),
    "sequential_ids": (("stream",), "SELECT run_id, seq, concat(run_id, '-', row_number() OVER (PARTITION BY run_id ORDER BY seq)) AS new_id FROM stream WHERE event_type = 'TIMER_SET'"),
    "null_normalised": ((), "SELECT event_id, CASE WHEN event_id % 3 = 1 THEN props END AS payload, CASE WHEN event_id % 3 = 1 THEN props ELSE '{}' END AS body FROM events"),
    "stream_open_waits": (("waits",), "SELECT run_id, step_id, kind FROM waits"),
    "stream_signal_dedup": (("signals",), "SELECT run_id, count(DISTINCT signal_id) AS signals FROM signals GROUP BY 1"),
    "replay_decision": ((), "SELECT concat('C', conv_id) AS run_id, CASE WHEN n < 2 THEN 'CALL_TOOL' ELSE 'COMPLETE' END AS kind, CASE WHEN n < 2 THEN concat('S', n + 1) END AS step_id, NULL::VARCHAR AS error FROM (SELECT conv_id, count(*) FILTER (role = 'assistant') AS n FROM conversations GROUP BY 1)"),
    "task_by_id": (('tasks',), f"SELECT task_id, run_id, step_id, task_type, status, priority, {at('created_at')} FROM tasks WHERE task_id = 'T42.0'"),
    "effect_ledger": (('effects',), f"""WITH RECURSIVE m AS (SELECT * FROM (VALUES (0, 'PENDING', 'RUNNING'), (1, 'RUNNING', NULL), (2, 'UNKNOWN', 'COMMITTED'), (3, 'COMMITTED', 'RUNNING')) AS t(n, a, b)),
        f AS (SELECT effect_key, answer, effect_class, -1 AS n, status, NULL::VARCHAR AS a, NULL::VARCHAR AS b, NULL::VARCHAR AS outcome, false AS told FROM effects
        UNION ALL SELECT effect_key, answer, effect_class, n, CASE WHEN outcome = 'OK' THEN b ELSE status END, a, b, outcome, told OR (outcome = 'OK' AND n = 1) FROM (SELECT *, CASE WHEN status <> a THEN 'CONFLICT' WHEN NOT {legal(EFFECT_MOVES)} THEN 'ILLEGAL' ELSE 'OK' END AS outcome FROM (SELECT f.effect_key, f.answer, f.effect_class, m.n, f.status, f.told, m.a, coalesce(m.b, CASE f.answer WHEN 'COMMITTED' THEN 'COMMITTED' WHEN 'NOT_EXECUTED' THEN 'FAILED' ELSE 'UNKNOWN' END) AS b FROM f JOIN m ON m.n = f.n + 1 WHERE effect_class <> 'NONE')))
        SELECT n, a AS "from", b AS "to", outcome, count(*) AS commands FROM f WHERE n >= 0 GROUP BY ALL"""),
    "latency_percentiles": (('log',), "SELECT min(seconds) FILTER (n >= 0.5 * total) AS p50, min(seconds) FILTER (n >= 0.95 * total) AS p95, min(seconds) FILTER (n >= 0.99 * total) AS p99 FROM (SELECT seconds, row_number() OVER (ORDER BY seconds) AS n, count(*) OVER () AS total FROM (SELECT date_sub('second', a, b) AS seconds FROM (SELECT min(created_at) FILTER (event_type = 'RUN_STARTED') AS a, min(created_at) FILTER (event_type = 'RUN_COMPLETED') AS b FROM log GROUP BY run_id) WHERE b >= a))"),
    "first_end_after_start": ((), "SELECT concat('U', user_id) AS run_id, date_sub('second', a, min(ts)) AS seconds FROM events JOIN (SELECT user_id, min(ts) AS a FROM events WHERE event_type = 'signup' GROUP BY 1) USING (user_id) WHERE event_type = 'purchase' AND ts >= a GROUP BY user_id, a"),
    "replay_parallel": (('runs',), f"SELECT run_id, kind, CASE WHEN kind = 'CALL_TOOL_PARALLEL' THEN 'S1' END AS step_id, CASE WHEN kind = 'COMPLETE' THEN concat(ok, '/', settled) END AS output, kind = 'CALL_TOOL_PARALLEL' AS reissued FROM (SELECT *, CASE WHEN {policy_error('policy', 'n')} IS NOT NULL THEN 'FAIL' WHEN {satisfied('policy', 'n', 'ok', 'settled')} THEN 'COMPLETE' ELSE 'CALL_TOOL_PARALLEL' END AS kind FROM (SELECT r.run_id, r.policy, count(l_orderkey) AS n, count(*) FILTER (l_returnflag = 'A') AS ok, count(*) FILTER (l_returnflag = 'A' OR (l_returnflag = 'R' AND l_partkey % 4 <> 0)) AS settled FROM runs r LEFT JOIN lineitem ON concat('R', l_orderkey) = run_id GROUP BY ALL))"),
    "replay_waits": (('stream',), """WITH e AS (SELECT *, event_type IN ('TIMER_SET', 'SIGNAL_WAIT_STARTED') AS o, event_type IN ('TIMER_FIRED', 'SIGNAL_RECEIVED') AS c FROM stream),
        w AS (SELECT run_id, step_id, min(seq) FILTER (o) AS fo, max(seq) FILTER (o) AS lo, min(seq) FILTER (c) AS fc, max(seq) FILTER (c) AS lc FROM e GROUP BY ALL),
        r AS (SELECT run_id, arg_min(created_at, seq) AS t FROM stream GROUP BY 1),
        d AS (SELECT r.run_id, t, EXISTS (FROM w WHERE w.run_id = r.run_id AND fc IS NOT NULL AND (fo IS NULL OR fc < fo)) AS bad, a.lo IS NOT NULL AS in1, coalesce(a.lc > a.lo, false) AS over1, b.lo IS NOT NULL AS in2, coalesce(b.lc > b.lo, false) AS over2 FROM r LEFT JOIN w a ON a.run_id = r.run_id AND a.step_id = 'S1' LEFT JOIN w b ON b.run_id = r.run_id AND b.step_id = 'S2'),
        k AS (SELECT *, CASE WHEN bad THEN 'FAIL' WHEN NOT over1 THEN 'SLEEP' WHEN NOT over2 THEN 'WAIT_FOR_SIGNAL' ELSE 'COMPLETE' END AS kind FROM d),
        u AS (SELECT *, CASE WHEN kind = 'SLEEP' AND NOT in1 THEN t + INTERVAL 1 HOUR WHEN kind = 'WAIT_FOR_SIGNAL' AND NOT in2 THEN t + INTERVAL 2 HOUR END AS u FROM k)
        SELECT run_id, kind, CASE kind WHEN 'SLEEP' THEN 'S1' WHEN 'WAIT_FOR_SIGNAL' THEN 'S2' END AS step_id, CASE kind WHEN 'SLEEP' THEN in1 WHEN 'WAIT_FOR_SIGNAL' THEN in2 ELSE false END AS reissued, CASE WHEN kind = 'SLEEP' AND in1 THEN '2024-01-01T00:00:00' WHEN microsecond(u) % 1000000 = 0 THEN strftime(u, '%Y-%m-%dT%H:%M:%S') ELSE strftime(u, '%Y-%m-%dT%H:%M:%S.%f') END AS until, CASE WHEN kind = 'FAIL' THEN 'BrokenHistory' END AS error FROM u"""),
    "step_description": ((), "SELECT event_id, concat('tool', event_id % 3, '(', CASE WHEN event_id % 5 < 2 THEN '{}' ELSE concat('{\"k\": ', props::JSON ->> 'k', '}') END, ')') AS text FROM events"),
    "embedded_object": ((), "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN props ELSE '{}' END AS body FROM events"),
    "envelope_encode": ((), 'SELECT event_id, concat(\'{"v":1,"data":{"kind":"\', event_type, \'","user":\', user_id, \'}}\') AS payload FROM events'),
    "effect_event": (('effects',), """SELECT effect_key, concat('{"task_id":"', task_id, '","idempotency_key":"', effect_key, '","effect_type":"', effect_type, '","effect_class":"', effect_class, '","status":"', status, '"', CASE WHEN status = 'COMMITTED' THEN concat(',"external_ref":"', answer, '"') WHEN status = 'UNKNOWN' THEN ',"detail":"timed out"' ELSE '' END, '}') AS body FROM effects"""),
    "effect_class_wire": ((), "SELECT p_partkey, sent, ['NONE', 'IDEMPOTENT_BY_KEY', 'QUERYABLE', 'UNRECONCILABLE'][nullif(sent, 0)] AS effect_class, CASE WHEN sent IN (0, 9) THEN 'unknown class' END AS error FROM (SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN 0 WHEN p_partkey % 7 = 6 THEN 9 ELSE p_partkey % 4 + 1 END::INTEGER AS sent FROM part)"),
    "instants": ((), "SELECT event_id, epoch_us(ts) * 1000 AS nanos, true AS same FROM events"),
    "enum_validity": (('runs', 'tasks', 'effects'), "SELECT DISTINCT status, status IN ('RUNNING', 'COMPLETED', 'FAILED', 'CANCELLED') AS run, status IN ('PENDING', 'RUNNING', 'COMPLETED', 'FAILED', 'CANCELLED', 'DEAD_LETTER') AS task, status IN ('PENDING', 'RUNNING', 'COMMITTED', 'FAILED', 'UNKNOWN') AS effect, status IN ('NONE', 'IDEMPOTENT_BY_KEY', 'QUERYABLE', 'UNRECONCILABLE') AS effect_class FROM (SELECT status FROM runs UNION ALL SELECT status FROM tasks UNION ALL SELECT status FROM effects UNION ALL SELECT effect_class FROM effects)"),
    "agent_runs": (('runs',), "SELECT agent_version, count(*) AS runs FROM runs WHERE status = 'RUNNING' AND agent_name = 'URGENT' GROUP BY 1"),
    "start_runs": ((), r"""SELECT concat('N', c_custkey) AS run_id, 'agent' AS agent_name, 'v1' AS agent_version, 'RUNNING' AS status, 0::BIGINT AS version, 1::BIGINT AS seq, 'RUN_STARTED' AS event_type, concat('{"agent_name":"agent","agent_version":"v1","input":"{\"customer\":', c_custkey, '}"}') AS body FROM customer"""),
    "execute_plan": (('tasks', 'effects', 'tools'), "SELECT action, CASE WHEN action = 'EXECUTE' AND held IS NULL THEN 'EFFECT_CREATED' WHEN action = 'ESCALATE' THEN 'EFFECT_ESCALATED' ELSE '' END AS events, count(*) AS tasks FROM (SELECT e.status AS held, CASE WHEN name IS NULL THEN 'UNKNOWN_TOOL' WHEN tools.effect_class = 'NONE' THEN 'CALL' WHEN e.status IS NULL OR e.status IN ('PENDING', 'FAILED') THEN 'EXECUTE' WHEN e.status = 'COMMITTED' THEN 'COMPLETE' WHEN tools.effect_class IN ('IDEMPOTENT_BY_KEY', 'QUERYABLE') THEN 'RECONCILE' ELSE 'ESCALATE' END AS action FROM tasks t LEFT JOIN tools ON name = task_type LEFT JOIN (FROM effects WHERE right(task_id, 1) < '2') e ON e.task_id = t.task_id WHERE t.status = 'PENDING') GROUP BY ALL"),
    "perform_rows": (('effects',), """WITH c AS (SELECT status, CASE answer WHEN 'COMMITTED' THEN 'COMMITTED' WHEN 'NOT_EXECUTED' THEN 'FAILED' ELSE 'UNKNOWN' END AS ends FROM effects WHERE status IN ('PENDING', 'FAILED'))
        SELECT n, a AS "from", b AS "to", e AS event, count(*) AS rows FROM (SELECT 1 AS n, status AS a, 'RUNNING' AS b, NULL AS e FROM c UNION ALL SELECT 2, 'RUNNING', ends, concat('EFFECT_', ends) FROM c) GROUP BY ALL"""),
    "recovery_scan": (('runs', 'tasks'), f"SELECT what, count(*) AS rows, min(id) AS least, max(id) AS most FROM (SELECT 'PUBLISH' AS what, task_id AS id FROM tasks WHERE status = 'PENDING' AND available_at <= {N} UNION ALL SELECT 'ADVANCE', run_id FROM runs r WHERE status = 'RUNNING' AND (available_at IS NULL OR available_at <= {N}) AND run_id NOT IN (SELECT run_id FROM tasks WHERE status IN ('PENDING', 'RUNNING'))) GROUP BY 1"),
    "advance_after_park": (('waits', 'signals'), "SELECT w.run_id, w.step_id, s.signal_id, CASE WHEN s.signal_id IS NULL THEN 'WAIT' ELSE 'ADVANCE' END AS action FROM waits w LEFT JOIN (SELECT run_id, signal_id FROM signals WHERE name = 'click' AND event_id % 3 <> 0 QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY created_at, signal_id) = 1) s ON s.run_id = w.run_id WHERE w.kind = 'SIGNAL'"),
    "relay_outcome": (('deliveries',), "SELECT published_at IS NULL AND outbox_id % 5 = 0 AS waiting, attempts + CASE WHEN published_at IS NULL AND outbox_id % 5 = 0 THEN 1 ELSE 0 END AS attempts, CASE WHEN published_at IS NULL AND outbox_id % 5 = 0 THEN 'refused' END AS last_error, count(*) AS deliveries FROM deliveries GROUP BY ALL"),
    "lease_extend": (('leases', 'lines'), f"SELECT task_id, fencing_token, {at('e', 'expires_at')} FROM (SELECT task_id, fencing_token, CASE WHEN l_partkey % 4 = 0 THEN l.expires_at WHEN l_partkey % 5 = 0 THEN {N} ELSE {N} + to_minutes(l_quantity::INTEGER) END AS e FROM leases l JOIN lines USING (task_id))"),
    "retaken_tasks": (('tasks', 'leases'), f"WITH t AS (SELECT *, row_number() OVER (ORDER BY priority DESC, available_at, created_at, task_id) AS n FROM tasks WHERE status = 'PENDING' AND available_at <= {N}), v AS (SELECT task_id, priority, tasks.created_at, CASE WHEN task_id IN (SELECT task_id FROM t WHERE n <= (SELECT count(DISTINCT worker_id) FROM leases)) THEN {N} + INTERVAL 1 MINUTE ELSE available_at END AS due FROM tasks WHERE status = 'PENDING') SELECT task_id, priority, {at('due', 'available_at')} FROM v WHERE due <= {N} + INTERVAL 2 MINUTE ORDER BY priority DESC, due, created_at, task_id LIMIT 50"),
    "migrations_applied": (('runs',), "WITH a AS (SELECT DISTINCT agent_version AS v FROM runs WHERE year(created_at) = 1997 AND agent_version IN ('v1', 'v3')), k AS (SELECT DISTINCT agent_version, agent_version IN (SELECT v FROM a) AS applied FROM runs) SELECT agent_version, applied, CASE WHEN NOT applied THEN row_number() OVER (PARTITION BY applied ORDER BY agent_version) END AS nth FROM k"),
}


def statement(name: str) -> str:
    """The query's SQL with the derived relations that it needs."""
    views, sql = SQL[name]
    need: list[str] = []

    def add(view: str) -> None:
        for v in VIEWS[view][0]:
            add(v)
        if view not in need:
            need.append(view)

    for v in views:
        add(v)
    parts = [f"{v} AS ({VIEWS[v][1]})" for v in need]
    if not parts:
        return sql
    rest = sql.removeprefix("WITH ").removeprefix("RECURSIVE ") if sql.startswith("WITH ") else None
    return "WITH RECURSIVE " + ",\n".join(parts) + (",\n" + rest if rest else "\n" + sql)


ORACLES = {name: statement(name) for name in SQL}
