"""Chat formatting: the cheapest repair of a conversation's roles, then its rendering.

A legal conversation is an optional system turn, then user and assistant in turn, ending with the assistant. Dynamic
programming over the automaton of legal turns chooses for every turn whether it keeps its role, is relabelled, or is
merged with the turn before it, and where empty turns are inserted, at the smallest total cost.

Scale: a conversation may be any share of the table. Turns are ranged over tasks in order, so a long conversation spans
several. Each task reduces a conversation that goes on outside it to the best cost between every state it may be entered
and left in; these tables (two per task at most, so bounded by the number of tasks) are joined up on the driver, which
tells each task its states; the tasks then trace their turns back. The result is one row per turn with its piece of the
rendered text, so no row grows with a conversation.

Defined results: turns go by ``turn`` (nulls first), then by role and text. Repeated rows are one turn; ``copies`` counts
them. Null or unknown roles are always relabelled. Null text is empty. A null conversation id is an id like others. An
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyward.llm.staging import Shelf, keep

ROLES = ("system", "user", "assistant")
#: States of the automaton: the role of the last turn, or none yet.
START = "start"
STATES = (START, *ROLES)
#: What must be inserted before a turn of the second role if the first came last; other pairs are not legal.
GAPS = {
    (START, "system"): (), (START, "user"): (), (START, "assistant"): ("user",),
    ("system", "user"): (), ("system", "assistant"): ("user",),
    ("user", "assistant"): (), ("user", "user"): ("assistant",),
    ("assistant", "user"): (), ("assistant", "assistant"): ("user",),
}
#: What must follow the last turn.
ENDS = {START: (), "system": ("user", "assistant"), "user": ("assistant",), "assistant": ()}
#: Turns that one task handles.
TASK_TURNS = 50_000


@dataclass(frozen=True)
class Costs:
    merge: int = 2
    relabel: int = 3
    insert: int = 4


def steps(role: str | None, costs: Costs) -> dict[str, list[tuple[str, int, str, tuple[str, ...]]]]:
    """For each state before a turn: the ways on, as (state after, cost, kind, inserted roles)."""
    out: dict[str, list] = {s: [] for s in STATES}
    for new in ROLES:
        extra = 0 if new == role else costs.relabel
        for state in STATES:
            if (state, new) in GAPS:
                gap = GAPS[state, new]
                out[state].append((new, extra + costs.insert * len(gap), "turn", gap))
            if state == new:
                out[state].append((new, extra + costs.merge, "merge", ()))
    return out


def best_paths(roles: list[str | None], reached: dict[str, int], costs: Costs) -> tuple[dict[str, int], list[dict]]:
    """Smallest cost of every state after the turns, from the costs before them, and the choices on the way.

    Among equal costs the earlier state in ``STATES`` wins, so the choice does not depend on where tasks meet.
    """
    known: dict[str | None, dict] = {}
    trace = []
    for role in roles:
        ways = known.setdefault(role, steps(role, costs))
        best: dict[str, tuple] = {}
        for state in (s for s in STATES if s in reached):
            for new, extra, kind, gap in ways[state]:
                if new not in best or reached[state] + extra < best[new][0]:
                    best[new] = (reached[state] + extra, state, kind, gap)
        trace.append(best)
        reached = {s: b[0] for s, b in best.items()}
    return reached, trace


def best_end(reached: dict[str, int], costs: Costs) -> str:
    """The state in which it is cheapest to end."""
    return min(reached, key=lambda s: (reached[s] + costs.insert * len(ENDS[s]), STATES.index(s)))


def traced(trace: list[dict], leave: str) -> tuple[list[tuple[str, str, tuple[str, ...]]], str]:
    """(new role, kind, inserted roles) of each turn on the best way to ``leave``, and the state it comes from."""
    out = []
    for best in reversed(trace):
        _, state, kind, gap = best[leave]
        out.append((leave, kind, gap))
        leave = state
    return out[::-1], leave


def _turns(path: list) -> int:
    return sum(len(gap) + (kind == "turn") for _, kind, gap in path)


def _numbered(batches):
    part, at = TaskContext.get().partitionId(), 0
    for batch in batches:
        n = batch.num_rows
        yield batch.append_column("part", pa.array([part] * n, pa.int32())).append_column("at", pa.array(range(at, at + n), pa.int64()))
        at += n


def _segments(table: pa.Table) -> list[tuple[int, int]]:
    """Ranges of rows of one conversation, for rows in order."""
    ids = table.column("conv_id").to_pylist()
    starts = [k for k in range(len(ids)) if not k or ids[k] != ids[k - 1]]
    return list(zip(starts, [*starts[1:], len(ids)], strict=True))


def _costs_between(costs: Costs):
    """First and last conversation of a task: smallest cost between every two states."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("at")
        roles, segments = table.column("role").to_pylist(), _segments(table)
        rows = []
        for k in sorted({0, len(segments) - 1}):
            a, b = segments[k]
            conv = table.column("conv_id")[a].as_py()
            for enter in STATES:
                reached, _ = best_paths(roles[a:b], {enter: 0}, costs)
                rows += [(conv, k, len(segments) - 1, enter, leave, cost) for leave, cost in reached.items()]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        names = ["conv_id", "segment", "last", "enter", "leave", "cost"]
        columns = {n: pa.array(c, t) for n, c, t in zip(names, zip(*rows, strict=True), kinds, strict=True)}
        return pa.table({"part": pa.array([table.column("part")[0].as_py()] * len(rows), pa.int32()), **columns})

    return run


def _ways_back(costs: Costs, entered: dict):
    """For conversations that span tasks: the state a best way to each last state comes from, and the turns it makes."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("at")
        part, roles, rows = table.column("part")[0].as_py(), table.column("role").to_pylist(), []
        for k, (a, b) in enumerate(_segments(table)):
            if (part, k) in entered:
                reached, trace = best_paths(roles[a:b], entered[part, k], costs)
                for leave in reached:
                    path, enter = traced(trace, leave)
                    rows.append((part, k, leave, enter, _turns(path)))
        kinds = [pa.int32(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
        names = ["part", "segment", "leave", "enter", "made"]
        return pa.table({n: pa.array(c, t) for n, c, t in zip(names, columns, kinds, strict=True)})

    return run


def _chains(rows: list) -> tuple[list[list[tuple[int, int]]], dict]:
    """The segments of each conversation that spans tasks, in order; and the costs between states of each segment."""
    tables: dict[tuple[int, int], dict] = {}
    for r in rows:
        entry = tables.setdefault((r.part, r.segment), {"conv": r.conv_id, "last": r.last, "cost": {}})
        entry["cost"][r.enter, r.leave] = r.cost
    chains: list[list[tuple[int, int]]] = []
    for key in sorted(tables):
        before = chains[-1][-1] if chains else None
        joins = before and key[1] == 0 and before[1] == tables[before]["last"] and tables[before]["conv"] == tables[key]["conv"]
        if joins:
            chains[-1].append(key)
        else:
            chains.append([key])
    return [c for c in chains if len(c) > 1], tables


def _joined(staged: DataFrame, costs: Costs) -> dict[tuple[int, int], tuple[dict, str, int, bool, bool]]:
    """For segments of conversations that span tasks: costs on entering, state left, turns made before, first, last."""
    groups = staged.select("part", "at", "conv_id", "role").groupBy("part")
    schema = "part int, conv_id long, segment long, last long, enter string, leave string, cost long"
    chains, tables = _chains(groups.applyInArrow(_costs_between(costs), schema).collect())  # at most 32 rows a task
    if not chains:
        return {}
    entered, ends = {}, []
    for chain in chains:
        reached = {START: 0}
        for key in chain:
            entered[key] = reached
            after: dict[str, int] = {}
            for (enter, leave), cost in tables[key]["cost"].items():
                if enter in reached:
                    after[leave] = min(after.get(leave, reached[enter] + cost), reached[enter] + cost)
            reached = after
        ends.append(best_end(reached, costs))
    schema = "part int, segment long, leave string, enter string, made long"
    back = {(r.part, r.segment, r.leave): r for r in groups.applyInArrow(_ways_back(costs, entered), schema).collect()}
    out = {}
    for chain, leave in zip(chains, ends, strict=True):
        left = {}
        for key in reversed(chain):
            left[key] = leave
            leave = back[*key, leave].enter
        made = 0
        for key in chain:
            out[key] = (entered[key], left[key], made, key == chain[0], key == chain[-1])
            made += back[*key, left[key]].made
    return out


def opened(role: str) -> str:
    return f"<|{role}|>\n"


CLOSED = "\n<|end|>\n"


def pieces(path: list, texts: list[str], begins: bool, ends: bool) -> list[str]:
    """Each turn's piece of the rendered conversation; a turn is closed by the piece after it."""
    out = []
    for k, ((role, kind, gap), text) in enumerate(zip(path, texts, strict=True)):
        if kind == "merge":
            out.append("\n" + text)
        else:
            closing = "" if begins and k == 0 else CLOSED
            out.append(closing + "".join(opened(r) + CLOSED for r in gap) + opened(role) + text)
    if ends and out:
        out[-1] += CLOSED + "".join(opened(r) + CLOSED for r in ENDS[path[-1][0]])
    return out


def _repairer(costs: Costs, spans: dict):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("at")
        part, segments = table.column("part")[0].as_py(), _segments(table)
        roles, texts = table.column("role").to_pylist(), [t or "" for t in table.column("text").to_pylist()]
        new, action, number, inserted, rendered = [], [], [], [], []
        for k, (a, b) in enumerate(segments):
            entered, leave, made, first, last = spans.get((part, k), ({START: 0}, None, 0, True, True))
            reached, trace = best_paths(roles[a:b], entered, costs)
            path, _ = traced(trace, leave or best_end(reached, costs))
            rendered += pieces(path, texts[a:b], first, last)
            for n, (role, kind, gap) in enumerate(path, a):
                made += len(gap) + (kind == "turn")
                new.append(role)
                action.append(("merge" if kind == "merge" else "keep") + ("" if role == roles[n] else "+relabel"))
                number.append(made - 1)
                inserted.append(len(gap) + (len(ENDS[role]) if last and n == b - 1 else 0))
        return pa.table({
            "conv_id": table.column("conv_id"), "turn": table.column("turn"), "role": table.column("role"),
            "copies": table.column("copies"), "new_role": pa.array(new, pa.string()), "action": pa.array(action, pa.string()),
            "out_turn": pa.array(number, pa.int64()), "inserted": pa.array(inserted, pa.int64()),
            "rendered": pa.array(rendered, pa.string()),
        })

    return run


def repair(turns: DataFrame, costs: Costs = Costs(), task_turns: int = TASK_TURNS) -> DataFrame:
    """Repair and render every conversation.

    Takes ``conv_id, turn, role, text``; returns per turn ``conv_id, turn, role, copies, new_role, action, out_turn,
    inserted, rendered``: the number of the repaired turn it belongs to, how many empty turns are inserted before it
    (and after a conversation's last), and its piece of the text. Pieces in order make up the conversation.
    """
    shelf = Shelf(turns.sparkSession)
    turns = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    turns = turns.groupBy(*turns.columns).agg(F.count("*").alias("copies"))
    order = ["conv_id", "turn", "role", F.xxhash64("text"), "text"]
    tasks = max(1, -(-turns.count() // task_turns))
    ranged = turns.repartitionByRange(tasks, *order[:4]).sortWithinPartitions(*order)
    schema = "conv_id long, turn long, role string, text string, copies long, part int, at long"
    staged = shelf.put(ranged.mapInArrow(_numbered, schema), "turns")
    spans = _joined(staged, costs)
    out = "conv_id long, turn long, role string, copies long, new_role string, action string, out_turn long, inserted long, rendered string"
    result = keep(staged.groupBy("part").applyInArrow(_repairer(costs, spans), out), "repaired")
    shelf.drop()
    return result
