"""Turns inferred from records that carry no turn key: a finite control, three
numbers, and what a stretch of records does to any state.

A record is read as a *letter*, all that the control needs of it. The control says
for each phase what a letter does; where that hangs on a number it names a test:

* ``early``: the record is older than the newest proven end (``floor``),
* ``joins``: the record had been taken as input (``taken``) by then,
* ``after`` / ``fits``: the end does not precede, or agrees with, ``start``.

So a stretch of records is a function with few pieces: per entry phase and range of
the entry's numbers one exit state, whose numbers are either its own, the entry's
or the larger of both. ``Stretch`` finds it in one reading, runs that have
come together go on as one, and ``follow`` composes two functions. Stretches
can so be read in any order and joined pairwise.
"""

from __future__ import annotations

import itertools
import json
from typing import NamedTuple

SECOND = 1_000_000
SKEW = 2  # seconds by which an end record may disagree with the saved start

IDLE, PENDING, RUNNING, UNSURE, GONE = "idle", "pending", "running", "unsure", "gone"


class Control(NamedTuple):
    phase: str = IDLE
    gap: bool = False  # idle, and a record was lost
    local: bool = False  # idle, but something unseen may be running
    excused: bool = False  # right after an abort, whose response may still come
    clean: bool = False  # the current state is dated
    known: bool = False
    silent: bool = False  # running, and may be over already
    command: bool = False  # pending on a slash command
    spent: bool = False  # pending on a key that has finished a turn before


class Letter(NamedTuple):
    kind: str
    timed: bool = False
    quiet: bool = True  # the roster is valid and no child runs
    masks: bool = False
    injected: bool = False
    command: bool = False
    keyed: bool = False
    spent: bool = False
    final: bool = False
    prompt: bool = False
    local_command: bool = False
    local_output: bool = False
    measured: bool = False
    possible: bool = False
    background: bool = False


class Leaf(NamedTuple):
    """Where a letter leads: the control, what becomes of the numbers, what is told."""

    control: Control
    moves: tuple = ()
    told: tuple = ()


class Test(NamedTuple):
    name: str
    yes: Leaf
    no: Leaf


LOST = ("lost",)


def unsure(c: Control, *moves: str) -> Leaf:
    """A turn of unknown start may be running until an end is proven."""
    return Leaf(Control(UNSURE, excused=c.excused), ("close", *moves), (LOST,))


def adrift(c: Control, *moves: str) -> Leaf:
    """Idle as far as we can tell, with something missing."""
    return Leaf(c._replace(gap=True, clean=False, known=False), moves, (LOST,))


def stopped(x: Letter, known: bool, *told: tuple, **facts: bool) -> Leaf:
    """Idle after a proven end; an untimed one leaves a gap."""
    if x.timed:
        return Leaf(Control(IDLE, known=known, **facts), ("close", "raise"), told)
    return Leaf(Control(IDLE, gap=True, **facts), ("close", "raise"), (*told, LOST))


def aborted(c: Control, x: Letter) -> Leaf | Test:
    """An abort of a turn: kept if its start is dated; nothing checks its bounds, so the total is gone."""
    rejected = stopped(x, False, LOST, ("gate", "abort.rejected"), excused=True)
    if not (c.clean and x.quiet and x.timed):
        return rejected
    return Test("after", stopped(x, True, ("turn", "aborted"), LOST, ("gate", "abort.kept"), excused=True), rejected)


def idle(c: Control, waiting: bool, x: Letter) -> Leaf | Test:
    calm = c._replace(excused=False)
    match x.kind:
        case "break" | "break_queue":
            return unsure(c) if c.gap else adrift(c)
        case "plain":
            return unsure(c) if x.prompt else Leaf(c._replace(clean=c.clean and not x.local_command))
        case "take":
            if c.gap:
                return unsure(calm, "raise")
            return Leaf(calm, ("raise",)) if x.timed else adrift(calm, "raise")
        case "reply":
            return Leaf(calm) if c.excused and not c.gap else unsure(calm)
        case "ask":
            doubtful = unsure(calm)
            if c.gap or not x.keyed or (c.local and x.injected):
                return doubtful
            opened = Control(PENDING, clean=c.clean and not x.injected, known=c.known, command=x.command, spent=x.spent)
            return Test("early", doubtful, Leaf(opened, ("open",)))
        case "abort":
            return stopped(x, c.known and not c.local, *[LOST] * c.local, excused=True)
        case "end":
            return stopped(x, c.known and c.excused, *[LOST] * (not c.excused), local=True)
    return Leaf(c)


def lost_track(c: Control, waiting: bool, x: Letter) -> Leaf:
    """Only a proven end brings an unsure session back."""
    match x.kind:
        case "break":
            return unsure(c)
        case "plain" if x.prompt:
            return unsure(c)
        case "take":
            return Leaf(c._replace(excused=False), ("raise",))
        case "reply" | "ask":
            return Leaf(c._replace(excused=False))
        case "abort":
            return stopped(x, False, excused=True)
        case "end":
            return stopped(x, False, LOST, local=True)
    return Leaf(c)


def pending(c: Control, waiting: bool, x: Letter) -> Leaf | Test:
    match x.kind:
        case "break" | "ask":
            return unsure(c)
        case "break_queue" if c.command:
            return unsure(c)
        case "plain":
            if c.command and (x.local_output or x.local_command):
                return unsure(c) if waiting else Leaf(Control(IDLE, local=True, known=c.known), ("close",))
            return Leaf(c._replace(clean=c.clean and not x.local_command))
        case "take":
            return Leaf(c, ("take",)) if x.timed else unsure(c) if c.command else Leaf(c)
        case "hush":
            return Leaf(c, ("forget",))
        case "reply":
            if c.spent:
                return unsure(c)
            return Leaf(Control(RUNNING, clean=c.clean and not x.final, known=True, silent=x.final), ("forget",) * x.final)
        case "abort":
            return stopped(x, False, LOST, excused=True) if c.spent else aborted(c, x)
        case "end":
            return stopped(x, False, LOST, local=True)
    return Leaf(c)


def running_(c: Control, waiting: bool, x: Letter) -> Leaf | Test:
    over = Leaf(c._replace(silent=True, clean=False), ("forget",))
    match x.kind:
        case "break":
            return unsure(c)
        case "plain":
            return unsure(c) if x.prompt and c.silent else Leaf(c._replace(clean=c.clean and not x.local_command))
        case "take" if x.timed and not c.silent:
            return Leaf(c, ("take",))
        case "hush":
            return over
        case "reply" if x.final:
            return over
        case "ask":
            if not x.keyed or not waiting:
                return unsure(c)
            return Test("joins", Leaf(c._replace(silent=False), ("forget",), (("joined",), ("gate", "join"))), unsure(c))
        case "abort":
            return aborted(c, x)
        case "end":
            if not x.measured:
                return stopped(x, False, LOST, ("gate", "end.missing"))
            rejected = stopped(x, False, LOST, ("gate", "end.rejected"))
            if not (x.possible and x.timed):
                return rejected
            kept = stopped(x, True, ("turn", "completed"), ("gate", "end.kept"), clean=x.quiet and not x.background)
            return Test("fits", kept, rejected)
    return Leaf(c)


PHASES = {IDLE: idle, PENDING: pending, RUNNING: running_, UNSURE: lost_track}
_RULES: dict[tuple, Leaf | Test] = {}


def rule(c: Control, waiting: bool, x: Letter) -> Leaf | Test:
    """What ``x`` does in ``c``; each case is worked out once."""
    if (c, waiting, x) not in _RULES:
        if c.phase == GONE:
            out = Leaf(c)
        elif x.kind == "foreign":
            out = Leaf(Control(GONE), ("close",), (LOST,))
        else:
            dated = c._replace(clean=False) if x.masks else c
            out = unsure(dated) if x.kind == "mystery" else PHASES[c.phase](dated, waiting, x)
        _RULES[c, waiting, x] = out
    return _RULES[c, waiting, x]


INPUTS = [
    "ord", "role", "lost", "foreign", "key", "repeated", "stamp", "injected", "command", "final_stop",
    "local_output", "local_command", "prompt", "take", "elapsed_ms", "background", "masks", "children_ok",
    "children_running",
]
SPENT = "spent"  # one more input of records whose key's past is known
KINDS = {"ignored": "plain", "unknown": "mystery", "silent": "hush", "assistant": "reply", "trigger": "ask", "abort": "abort", "end": "end"}


class Record(NamedTuple):
    letter: Letter
    ord: int
    second: int | None
    stamp: int | None
    begun: int | None  # the start that an end's own duration gives
    key: str | None
    repeated: bool


_LETTERS: dict[tuple, Letter] = {}


def letter(role, lost, foreign, timed, quiet, masks, keyed, spent, measured, possible, facts: tuple) -> Letter:
    """The letter of a record; ``facts`` are its inputs ``injected`` to ``take`` and ``background``."""
    injected, command, final_stop, local_output, local_command, prompt, take, background = facts
    if foreign:
        return Letter("foreign")
    if lost is not None:
        return Letter("break_queue" if lost == "queue" else "break")
    kind = KINDS.get(role, "plain") if role != "queue" else "take" if take else "nothing"
    out = Letter(kind, timed, quiet, bool(masks))
    if kind == "ask":
        return out._replace(injected=bool(injected), command=bool(command), keyed=keyed, spent=spent)
    if kind == "reply":
        return out._replace(final=bool(final_stop))
    if kind == "plain":
        if role == "ignored":
            return out._replace(prompt=bool(prompt), local_command=bool(local_command), local_output=bool(local_output))
        return out._replace(kind="nothing")
    if measured:
        return out._replace(measured=True, possible=possible, background=bool(background))
    return out


def read(row: tuple, used=()) -> Record:
    """The record as a letter. ``used`` are repeated keys that have finished a turn, asked where the record does not say.
    Letters are worked out once for all records that say the same."""
    ord, role, lost, foreign, key, repeated, stamp, *facts, elapsed, background, masks, children_ok, running = row[: len(INPUTS)]
    second = stamp // SECOND if stamp is not None else None
    timed = bool(second)
    plain = not foreign and lost is None
    begun, possible, spent = None, False, False
    measured = plain and role == "end" and elapsed is not None
    if measured:
        possible = stamp is not None and stamp >= elapsed * 1000
        begun = (stamp - elapsed * 1000) // SECOND if possible else None
    elif plain and role == "trigger":
        spent = row[len(INPUTS)] if len(row) > len(INPUTS) else None
        spent = bool(repeated and key in used if spent is None else spent)
    says = (role, lost, foreign, timed, bool(children_ok and running == 0), masks, key is not None and timed, spent, measured, possible, (*facts, background))
    if says not in _LETTERS:
        _LETTERS[says] = letter(*says)
    return Record(_LETTERS[says], ord, second, stamp, begun, key, bool(repeated))


# ------------------------------------------------------------- one state, record by record
def start() -> dict:
    return {
        "control": Control(), "start": None, "key": None, "taken": None, "seen": False,
        "used": [], "children_ok": True, "children_running": 0, "floor": 0,
    }


def step(s: dict, row: tuple, emit) -> None:
    """Advance a state over one record."""
    c = s["control"]
    if type(c) is list:
        c = Control(*c)
    if c.phase == GONE:
        return
    x = read(row, s["used"])
    s["children_ok"], s["children_running"] = row[17], row[18]
    now = rule(c, s["taken"] is not None, x.letter)
    if type(now) is Test:
        match now.name:
            case "early":
                holds = x.second < s["floor"]
            case "joins":
                holds = x.stamp <= s["taken"]
            case "after":
                holds = s["start"] <= x.second
            case "fits":
                holds = abs(x.begun - s["start"]) <= SKEW and s["start"] <= x.second
        now = now.yes if holds else now.no
    for what, *text in now.told:
        if what == "turn":
            emit(x.ord, what, s["start"], x.second, text[0])
            if s["key"] is not None:  # only keys that occur again are kept
                s["used"] = sorted({*s["used"], s["key"]})
                emit(x.ord, "used", None, None, s["key"])
        elif what == "joined":
            emit(x.ord, what, s["start"], x.second, x.key)
        else:
            emit(x.ord, what, None, None, *(text or [None]))
    for move in now.moves:
        if move == "open":
            s.update(start=x.second, key=x.key if x.repeated else None, taken=None)
        elif move == "close":
            s.update(start=None, key=None, taken=None)
        elif move == "take":
            s["taken"] = max(s["taken"] or 0, x.stamp)
        elif move == "forget":
            s["taken"] = None
        else:
            s["floor"] = max(s["floor"], x.second or 0)
    s["control"] = now.control
    s["seen"] = s["seen"] or x.letter.kind in ("ask", "end")


# ----------------------------------------------------------- any state, a stretch at a time
FAR = 1 << 62
ENTRY, ENTRY_KEY = "entry", 0  # the start (else a number) and key (else a text) that the stretch was entered with
FULL = (-FAR, FAR, -FAR, FAR, -FAR, FAR)  # ranges of the entry's start, taken and floor


class Exit(NamedTuple):
    """An exit state. ``taken`` and ``floor`` are (own value, whether the entry's counts too): the larger one holds."""

    control: Control
    start: int | str | None
    key: str | int | None
    taken: tuple | None
    floor: tuple


def _classes() -> list[tuple[Control, bool]]:
    bits = lambda n: itertools.product((False, True), repeat=n)
    out = [(Control(IDLE, g, l, e, c, k), False) for g, l, e, c, k in bits(5)]
    out += [(Control(UNSURE, excused=e), False) for (e,) in bits(1)]
    out += [(Control(PENDING, clean=c, known=k, command=m, spent=s), w) for c, k, m, s, w in bits(5)]
    out += [(Control(RUNNING, clean=c, known=True, silent=s), w) for c, s, w in bits(3)]
    return [*out, (Control(GONE), False)]


CLASSES = _classes()
CLASS = {c: i for i, c in enumerate(CLASSES)}


def narrowed(box: tuple, axis: int, low: int, high: int) -> tuple | None:
    low, high = max(low, box[2 * axis]), min(high, box[2 * axis + 1])
    return None if low > high else (*box[: 2 * axis], low, high, *box[2 * axis + 2 :])


def tidy(owners: list) -> list:
    """The same (class, ranges) with ranges that touch along one axis made one."""
    left = sorted(set(owners))
    for axis in range(3):
        rest = lambda o: (o[0], *o[1 : 1 + 2 * axis], *o[3 + 2 * axis :])
        left.sort(key=lambda o: (rest(o), o[1 + 2 * axis]))
        out = []
        for o in left:
            if out and rest(out[-1]) == rest(o) and o[1 + 2 * axis] <= out[-1][2 + 2 * axis] + 1:
                last = out.pop()
                o = (*last[: 2 + 2 * axis], max(last[2 + 2 * axis], o[2 + 2 * axis]), *o[3 + 2 * axis :])
            out.append(o)
        left = out
    return left


def taken_at_least(pair: tuple, bound: int, axis: int):
    """How ``max(pair) >= bound`` hangs on the entry: True, False, or its two ranges."""
    own, entry = pair
    if own >= bound:
        return True
    return ((axis, bound, FAR), [(axis, -FAR, bound - 1)]) if entry else False


class Stretch:
    """Reads a stretch of records once and gives its function as text."""

    def __init__(self, highest: int | None = None):
        """``highest``: a bound of the entry's floor, where one is known."""
        self.seen, self.runs = False, {}
        box = narrowed(FULL, 2, -FAR, FAR if highest is None else highest)
        for i, (c, waiting) in enumerate(CLASSES):
            open_ = (ENTRY, ENTRY_KEY) if c.phase in (PENDING, RUNNING) else (None, None)
            state = Exit(c, *open_, (-FAR, True) if waiting else None, (0, True))
            self.runs[state] = [(i, *box)]

    def step(self, row: tuple) -> None:
        x = read(row)
        out: dict[Exit, list] = {}
        for s, owners in self.runs.items():
            now = rule(s.control, s.taken is not None, x.letter)
            if type(now) is Leaf:
                out.setdefault(self.moved(s, now, x), []).extend(owners)
                continue
            match now.name:
                case "early":
                    cut = taken_at_least(s.floor, x.second + 1, 2)
                case "joins":
                    cut = taken_at_least(s.taken, x.stamp, 1)
                case "after":
                    cut = self.between(s.start, -FAR, x.second)
                case "fits":
                    cut = self.between(s.start, x.begun - SKEW, min(x.begun + SKEW, x.second))
            if type(cut) is bool:
                out.setdefault(self.moved(s, now.yes if cut else now.no, x), []).extend(owners)
                continue
            for leaf, ranges in ((now.yes, [cut[0]]), (now.no, cut[1])):
                kept = [(o[0], *b) for r in ranges for o in owners if (b := narrowed(o[1:], *r))]
                if kept:
                    out.setdefault(self.moved(s, leaf, x), []).extend(kept)
        for s, owners in out.items():
            if len(owners) > 2 * len(CLASSES):
                out[s] = tidy(owners)
        self.runs = out
        self.seen = self.seen or (x.letter.kind in ("ask", "end"))

    @staticmethod
    def between(start, low: int, high: int):
        if start == ENTRY:
            return ((0, low, high), [(0, -FAR, low - 1), (0, high + 1, FAR)])
        return low <= start <= high

    @staticmethod
    def moved(s: Exit, leaf: Leaf, x: Record) -> Exit:
        _, start, key, taken, floor = s
        for move in leaf.moves:
            if move == "open":
                start, key, taken = x.second, x.key if x.repeated else None, None
            elif move == "close":
                start = key = taken = None
            elif move == "take":
                taken = (max(taken[0], x.stamp), taken[1]) if taken else (x.stamp, False)
            elif move == "forget":
                taken = None
            else:
                floor = (max(floor[0], x.second or 0), floor[1])
        return Exit(leaf.control, start, key, taken, floor)

    def text(self) -> str:
        return dumped(self.seen, self.runs)


def dumped(seen: bool, runs: dict) -> str:
    return json.dumps([seen, [[s, tidy(owners)] for s, owners in runs.items()]])


def loaded(text: str) -> tuple[bool, dict]:
    seen, runs = json.loads(text)
    pair = lambda p: tuple(p) if p is not None else None
    state = lambda s: Exit(Control(*s[0]), s[1], s[2], pair(s[3]), pair(s[4]))
    return seen, {state(s): [tuple(o) for o in owners] for s, owners in runs}


def follow(first: tuple[bool, dict], then: tuple[bool, dict]) -> tuple[bool, dict]:
    """The function of two stretches, one after the other."""
    by_class: dict[int, list] = {}
    for s, owners in then[1].items():
        for i, *box in owners:
            by_class.setdefault(i, []).append((box, s))
    out: dict[Exit, list] = {}
    for s, owners in first[1].items():
        for box, end in by_class.get(CLASS[s.control, s.taken is not None], ()):
            # The ranges that the second asks of its entry, as ranges of the first's.
            asked = []
            for axis, value in enumerate(((s.start, False) if s.start != ENTRY else (-FAR, True), s.taken, s.floor)):
                own, entry = value if value is not None and value[0] is not None else (None, False)
                low, high = box[2 * axis], box[2 * axis + 1]
                if own is None:
                    continue
                if own > high or (not entry and own < low):
                    break
                if entry:
                    asked.append((axis, -FAR if own >= low else low, high))
            else:
                kept = owners
                for r in asked:
                    kept = [(o[0], *b) for o in kept if (b := narrowed(o[1:], *r))]
                if kept:
                    out.setdefault(joined(s, end), []).extend(kept)
    return first[0] or then[0], {s: tidy(owners) for s, owners in out.items()}


def joined(s: Exit, end: Exit) -> Exit:
    larger = lambda own, before: (max(own[0], before[0]), before[1]) if own[1] else own
    return Exit(
        end.control,
        s.start if end.start == ENTRY else end.start,
        s.key if end.key == ENTRY_KEY else end.key,
        None if end.taken is None else larger(end.taken, s.taken) if s.taken is not None else end.taken,
        larger(end.floor, s.floor),
    )


def composed(texts: list[str]) -> str:
    """The function of stretches in order."""
    out = loaded(texts[0])
    for t in texts[1:]:
        out = follow(out, loaded(t))
    return dumped(*out)


def walked(entry: str | None, floor: int, texts: list[str]) -> list[tuple[str, int]]:
    """Per stretch, in order, the state it is entered with: (state without floor, floor)."""
    s = start() | (json.loads(entry) if entry is not None else {})
    at = (s["seen"], {Exit(Control(*s["control"]), s["start"], s["key"], (s["taken"], False) if s["taken"] is not None else None, (floor, False)): [(0, *FULL)]})
    out = []
    for i, text in enumerate(texts):
        (state,) = at[1]
        taken = state.taken[0] if state.taken else None
        out.append((json.dumps({"control": state.control, "start": state.start, "key": state.key, "taken": taken, "seen": at[0]}), state.floor[0]))
        if i + 1 < len(texts):
            at = follow(at, loaded(text))
    return out
