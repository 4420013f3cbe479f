"""Error-correcting Earley parsing of message roles by a weighted grammar with delete, rerole and insert productions.

The grammar of a dialogue is left-linear, with one nonterminal for what has been said so far: nothing (Start), a
system message (System), a question (Asked) or an answer to the last question (Answered). A question and an answer
are nonterminals of their own: a message of that role as it is, another message with its role changed, or none at
all with a message inserted. Every state may be followed by a message that is deleted.

A chart item is a dotted production with the column where it began, and keeps its least (cost, audit); audits are
the letters of the edits in order. Two audits of one item and one cost are never prefixes of each other, since the
letters give the cost, so the least audit of the parts gives the least audit of the whole.

``parse`` takes a block of messages and the state that stands before it, and returns the states that can stand
after it. Blocks are joined by ``Repair``, so that long conversations are parsed in pieces, by one task after the other
or by many (``matrix``).
"""

from __future__ import annotations

import os
from dataclasses import dataclass, field
from functools import lru_cache

#: Messages that are parsed at once.
BLOCK = 100
STATES = ("Start", "System", "Asked", "Answered")
FINAL = ("Start", "Answered")
KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
#: What an undeleted truncated message adds.
TRUNCATED = 3

Best = tuple[int, str]


@dataclass(frozen=True)
class Production:
    name: str
    symbols: tuple[str, ...]
    cost: int = 0
    edit: str = ""


#: Terminals match one message: "=s" one of that role's initial, "*" any, both but for those that must go; "-" any at all.
GRAMMAR = (
    Production("System", ("Start", "System message")),
    Production("Asked", ("Start", "Question")),
    Production("Asked", ("System", "Question")),
    Production("Asked", ("Answered", "Question")),
    Production("Answered", ("Asked", "Answer")),
    Production("System message", ("=s",), 0, KEEP),
    Production("Question", ("=u",), 0, KEEP),
    Production("Answer", ("=a",), 0, KEEP),
    *(Production(x, ("*",), 3, REROLE) for x in ("Question", "Answer")),
    *(Production(x, (), 3, INSERT) for x in ("Question", "Answer")),
    *(Production(x, (x, "-"), 4, DELETE) for x in STATES),
)
_RULES = {name: [k for k, p in enumerate(GRAMMAR) if p.name == name] for name in {p.name for p in GRAMMAR}}
#: Productions that go on from a nonterminal that is complete.
_AFTER = {name: [k for k, p in enumerate(GRAMMAR) if p.symbols[:1] == (name,)] for name in _RULES}


def token(initial: str, fault: str) -> str:
    """A message as one letter: its role's initial s, u, a or another (x); capital if truncated; "-" if it must go."""
    if fault in ("blank", "duplicate"):
        return "-"
    letter = initial if initial in ("s", "u", "a") else "x"
    return letter.upper() if fault == "truncated" else letter


def _scan(symbol: str, message: str) -> int | None:
    """What it costs that a terminal matches a message; None if it does not."""
    if symbol == "-":
        return 0
    if message == "-" or (symbol != "*" and symbol[1] != message.lower()):
        return None
    return TRUNCATED if message.isupper() else 0


@lru_cache(maxsize=1 << 15)
def parse(messages: str, entry: str) -> dict[str, Best]:
    """The least (cost, audit) of each state after the messages (tokens), from the state ``entry`` before them."""
    waiting: list[dict[str, list[tuple[int, int, int]]]] = []  # by column and nonterminal: items whose dot stands before it
    columns: list[dict[tuple[int, int, int], Best]] = []  # (production, dot, column of origin): least value
    done: dict[tuple[str, int], Best] = {}
    seeds: dict[tuple[int, int, int], Best] = {}
    for at in range(len(messages) + 1):
        items, needs, done = {}, {}, {}
        columns.append(items)
        waiting.append(needs)
        todo = list(seeds.items())
        complete = [((entry, 0), (0, ""))] if at == 0 else []
        while todo or complete:
            if complete:
                (name, origin), value = complete.pop()
                if (name, origin) in done and done[name, origin] <= value:
                    continue
                done[name, origin] = value
                if origin == 0 and name in STATES:  # states begin where the block does
                    todo += [((k, 1, 0), value) for k in _AFTER[name]]
                if name not in STATES:
                    for key in waiting[origin].get(name, ()):
                        before = columns[origin][key]
                        todo.append(((key[0], key[1] + 1, key[2]), (before[0] + value[0], before[1] + value[1])))
                continue
            key, value = todo.pop()
            if key in items and items[key] <= value:
                continue
            items[key] = value
            k, dot, origin = key
            rule = GRAMMAR[k]
            if dot == len(rule.symbols):
                complete.append(((rule.name, origin), (value[0] + rule.cost, value[1] + rule.edit)))
                continue
            symbol = rule.symbols[dot]
            if symbol not in _RULES:
                continue  # a terminal, which the next column scans
            needs.setdefault(symbol, [])
            if key not in needs[symbol]:
                needs[symbol].append(key)
            todo += [((r, 0, at), (0, "")) for r in _RULES[symbol]]
            if (symbol, at) in done:  # it has been completed here already, without a message
                inner = done[symbol, at]
                todo.append(((k, dot + 1, origin), (value[0] + inner[0], value[1] + inner[1])))
        if at == len(messages):
            break
        seeds = {}
        for (k, dot, origin), value in items.items():
            rule = GRAMMAR[k]
            if dot < len(rule.symbols) and rule.symbols[dot] not in _RULES and (cost := _scan(rule.symbols[dot], messages[at])) is not None:
                seeds[k, dot + 1, origin] = (value[0] + cost, value[1])
        for gone in range(1, at):  # items begin at column 0 or at the one before a message
            columns[gone] = waiting[gone] = {}
    return {name: value for (name, origin), value in done.items() if origin == 0 and name in STATES}


@dataclass
class Repair:
    """The least (cost, audit) of each state after the messages so far; what all audits share is kept apart."""

    ends: dict[str, Best] = field(default_factory=lambda: {"Start": (0, "")})
    shared: list[str] = field(default_factory=list)

    def read(self, messages: str) -> None:
        for at in range(0, len(messages), BLOCK):
            block = messages[at : at + BLOCK]
            self.join({(entry, name): best for entry in self.ends for name, best in parse(block, entry).items()})

    def join(self, matrix: dict[tuple[str, str], Best]) -> None:
        """Goes on by a block's least (cost, audit) from state to state."""
        ends: dict[str, Best] = {}
        for (entry, name), (cost, audit) in matrix.items():
            if entry in self.ends:
                whole = (self.ends[entry][0] + cost, self.ends[entry][1] + audit)
                if name not in ends or whole < ends[name]:
                    ends[name] = whole
        prefix = os.path.commonprefix([audit for _, audit in ends.values()])
        if prefix:
            self.shared.append(prefix)
            ends = {name: (cost, audit[len(prefix) :]) for name, (cost, audit) in ends.items()}
        self.ends = ends

    def result(self) -> Best:
        """Cost and audit of the repair of all messages. A conversation of none may end as well."""
        cost, audit = min(self.ends[x] for x in FINAL if x in self.ends)
        return cost, "".join([*self.shared, audit])


def matrix(messages: str) -> dict[tuple[str, str], Best]:
    """The least (cost, audit) from every state to every state over a piece of a conversation."""
    out = {}
    for entry in STATES:
        repair = Repair({entry: (0, "")})
        repair.read(messages)
        before = "".join(repair.shared)
        out |= {(entry, name): (cost, before + audit) for name, (cost, audit) in repair.ends.items()}
    return out

