"""License scans: templates with optional and replaceable regions as token automata."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from .license_templates import TEMPLATES
from .shared import bounded_batches, sql_type

#: Phrases and labels of the plain search.
PHRASES = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]
#: Bytes to words: A-Z to a-z, other ASCII than digits and letters to a blank, all else as it is.
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))
_MARK = re.compile(r"<<(beginOptional|endOptional|var;match=(.*?))>>", re.S)


def words(text: bytes) -> list[bytes]:
    return text.translate(_WORDS).split()


def places(line: bytes, run: bytes):
    """Where the words of ' a b ' begin in ' ' + words, each with a blank after it, counted in words."""
    before, word, at = 0, 0, line.find(run)
    while at >= 0:
        word += line.count(b" ", before, at)
        yield word
        before, at = at, line.find(run, at + 1)


@dataclass
class Seq:
    items: list = field(default_factory=list)


@dataclass
class Optional:
    body: Seq


@dataclass
class Replaceable:
    choices: list[tuple[bytes, ...]]
    least: int | None
    most: int | None


def parse(template: str) -> Seq:
    """Literal words, Optional and Replaceable regions; open and leading ones stay in place."""
    stack, at = [Seq()], 0
    for m in _MARK.finditer(template):
        stack[-1].items += words(template[at : m.start()].encode())
        at = m.end()
        if m[1] == "beginOptional":
            stack.append(Seq())
        elif m[1] == "endOptional":
            body = stack.pop()
            stack[-1].items.append(Optional(body))
        else:
            free = re.search(r"\{(\d+),(\d+)\}", m[2])
            choices = [tuple(words(c.encode())) for c in m[2].split("|") if "{" not in c]
            stack[-1].items.append(Replaceable(choices, int(free[1]) if free else None, int(free[2]) if free else None))
    if len(stack) != 1:
        raise ValueError("an optional region is not closed")
    stack[-1].items += words(template[at:].encode())
    return stack[0]


class Automaton:
    """States with word edges, free edges (any word) and empty edges; accepts where state `end` is reached.

    A search lets a template begin anywhere, so regions before the first mandatory word decide nothing
    and are dropped, as are regions after the last one."""

    def __init__(self, template: str):
        seq = parse(template)
        must = [i for i, x in enumerate(seq.items) if isinstance(x, bytes)]
        if not must:
            raise ValueError("a template needs mandatory words")
        first = must[0]
        lead = seq.items[:first]
        if any(isinstance(x, Replaceable) and x.least != 0 and x.least is None for x in lead):
            first = 0  # one of stated wordings must stand there
        run = []
        for x in seq.items[must[0] :]:
            if not isinstance(x, bytes):
                break
            run.append(x)
        self.anchor = b" " + b" ".join(run) + b" "
        self.word: list[dict[bytes, list[int]]] = []
        self.any: list[list[int]] = []
        self.empty: list[list[int]] = []
        self.start = self._state()
        lead_end = self._build(seq.items[first : must[0]], self.start)
        self.lead = lead_end != self.start
        self.after_lead = lead_end
        self.end = self._build(seq.items[must[0] : must[-1] + 1], lead_end)
        self.lead_words = [c for x in seq.items[first : must[0]] if isinstance(x, Replaceable) for c in x.choices]

    def _state(self) -> int:
        self.word.append({})
        self.any.append([])
        self.empty.append([])
        return len(self.word) - 1

    def _literal(self, run, at: int) -> int:
        for w in run:
            to = self._state()
            self.word[at].setdefault(w, []).append(to)
            at = to
        return at

    def _build(self, items, at: int) -> int:
        for x in items:
            if isinstance(x, bytes):
                at = self._literal([x], at)
                continue
            out = self._state()
            if isinstance(x, Optional):
                self.empty[self._build(x.body.items, at)].append(out)
                self.empty[at].append(out)
            else:
                for c in x.choices:
                    self.empty[self._literal(c, at)].append(out)
                if x.most is not None:
                    s = at
                    for n in range(x.most + 1):
                        if n >= x.least:
                            self.empty[s].append(out)
                        if n < x.most:
                            to = self._state()
                            self.any[s].append(to)
                            s = to
            at = out
        return at

    def _closed(self, states: set[int]) -> set[int]:
        todo = list(states)
        while todo:
            for t in self.empty[todo.pop()]:
                if t not in states:
                    states.add(t)
                    todo.append(t)
        return states

    def accepts_at(self, text: list[bytes], i: int, state: int) -> bool:
        """Whether the mandatory wording stands in order from word i on, from that state."""
        now = self._closed({state})
        while now and self.end not in now:
            if i >= len(text):
                return False
            w, i = text[i], i + 1
            now = self._closed({t for s in now for t in (*self.word[s].get(w, ()), *self.any[s])})
        return self.end in now

    def found(self, text: list[bytes], line: bytes) -> bool:
        for i in places(line, self.anchor):
            if not self.lead:
                if self.accepts_at(text, i, self.start):
                    return True
            elif any(tuple(text[i - n : i]) == c for c in self.lead_words if (n := len(c)) <= i) and self.accepts_at(text, i, self.after_lead):
                return True
        return False


def scan_licenses(docs: DataFrame, templates=None, phrases=None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score) for every row of docs.

    A text is cut to words (A-Z in lower case; other ASCII than letters and digits parts words). n_base,
    first_word and last_word tell of the places where a phrase's words stand one after another. Each
    template is a token automaton: it adds its label where all mandatory wording stands exactly, with its
    optional regions present or not and its replaceable ones filled as they allow. score: 1 where a
    template accepts, 0.5 where only a phrase stands, else 0. Null and empty texts give zeros, null
    places and empty labels; repeated rows and rows with a null id each give a row; an empty table gives none; other
    columns are not read. There is no shuffle, and a text is read whole, once; the automata run only where a
    template's opening words stand. What stands before or after a template's wording doesn't matter."""
    bounded_batches(docs)
    automata = [(label, Automaton(t)) for label, t in (TEMPLATES if templates is None else templates)]
    plain = [(b" " + b" ".join(words(p.encode())) + b" ", label) for p, label in (PHRASES if phrases is None else phrases)]
    names = [id_col, "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64()]

    def one(text: bytes | None):
        if not text:
            return 0, 0, None, None, "", "", 0.0
        own = words(text)
        line = b" " + b" ".join(own) + b" "
        n, first, last, base = 0, None, None, set()
        for phrase, label in plain:
            for i in places(line, phrase):
                n, first, last = n + 1, i if first is None else min(first, i), i if last is None else max(last, i)
                base.add(label)
        added = {label for label, a in automata if a.found(own, line)}
        score = 1.0 if added else 0.5 if base else 0.0
        return len(own), n, first, last, ",".join(sorted(base)), ",".join(sorted(base | added)), score

    def scanned(batches):
        for batch in batches:
            rows = list(zip(*map(one, batch.column(1).cast(pa.binary()).to_pylist()))) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(rows, kinds))], names)

    schema = f"`{id_col}` {sql_type(docs, id_col)}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    return docs.select(id_col, text_col).mapInArrow(scanned, schema)
