"""Source text to syntax nodes: the one step outside Catalyst.

``read_forms`` is an iterative reader, so nesting depth is bounded by memory only. It fills flat columns in
pre-order; a node's subtree is the run of ``size`` rows that starts with it. ``node_batch`` turns many files'
columns into one Arrow batch: child and subtree arrays are slices taken from the flat columns, without a
Python object per entry.

Reader rules: metadata and the form it marks are siblings; ``#(...)`` holds the call's elements itself; a
var quote is a leaf; a discarded form stays in the tree; maps hold keys and values in turn; keywords keep
their colons; every node ends one column after its start. A file that cannot be read gives no nodes.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa

TOKEN = re.compile(r'[^\s,;"\'`~@^()\[\]{}\\][^\s,;"`~@^()\[\]{}\\]*')
#: What most of a text is, behind blanks: a word, an opening, or a closing.
PLAIN = re.compile(rf"[\s,]*(?:((?!#){TOKEN.pattern})|([(\[{{])|([)\]}}]))?")
OPEN = {"(": ("List", ")"), "[": ("Vector", "]"), "{": ("Map", "}")}
PREFIX = {"'": "Quote", "`": "SyntaxQuote", "@": "Deref", "~": "Unquote"}
#: Heads whose whole subtree rules look at, beside those that the caller names; other lists carry theirs down to ``SHALLOW``
#: levels, which is more than any rule reads of them. Lists that are marked private carry all.
WIDE = frozenset(
    "defn defn- defmacro defmethod defmulti def defonce fn letfn let loop go go-loop ns case put! >! >!! = not= contains? get swap! reset! alter ref-set commute vswap! vreset! "
    "send send-off atom volatile! ref agent map filter remove mapcat keep for lazy-seq defprotocol defrecord clojure.core/let cljs.core/let defsc fp/defsc".split()
)
SHALLOW = 4
FUNCTIONS = frozenset(("defn", "defn-", "defmacro", "defmethod", "defmulti", "fn"))
FLAGS = {"let": 1, "loop": 2, "binding": 3, "dosync": 4, "with-open": 5}
FIELDS = ("i", "p", "d", "k", "t", "v", "h", "n", "z", "l", "c")
ENTRY = "struct<i:int,p:int,d:int,k:int,t:string,v:string,h:string,n:int,z:int,l:int,c:int>"
SCHEMA = (
    f"path string, id int, parent int, idx int, depth int, size int, type string, value string, head string, n int, line int, col int, kids array<{ENTRY}>, sub array<{ENTRY}>, "
    "enclosing array<string>, in_function boolean, in_let boolean, in_loop boolean, in_binding boolean, in_dosync boolean, in_with_open boolean, up_type string, up_head string, up_n int, ast string"
)


class Unreadable(ValueError):
    pass


class Forms:
    """Flat pre-order columns of one file."""

    def __init__(self) -> None:
        self.type: list[str] = []
        self.value: list[str] = []
        self.line: list[int] = []
        self.col: list[int] = []
        self.parent: list[int] = []
        self.idx: list[int] = []
        self.depth: list[int] = []
        self.size: list[int] = []
        self.count: list[int] = []
        self.comments: list[tuple[str, int, int]] = []


def read_forms(text: str) -> Forms:
    out = Forms()
    types, sizes, counts = out.type, out.size, out.count
    add_type, add_value, add_line, add_col, add_parent, add_idx, add_depth, add_size, add_count = (
        x.append for x in (types, out.value, out.line, out.col, out.parent, out.idx, out.depth, sizes, counts)
    )
    stack: list[tuple[int, str | None]] = []  # open nodes and what closes them; None: the next form does
    roots = 0
    line_no = 0
    i, n = 0, len(text)
    starts = [0, *(m.end() for m in re.finditer("\n", text)), n + 1]

    def add(kind: str, value: str, at: int) -> int:
        nonlocal roots, line_no
        while starts[line_no + 1] <= at:
            line_no += 1
        k = len(types)
        add_type(kind)
        add_value(value)
        add_line(line_no + 1)
        add_col(at - starts[line_no] + 1)
        add_depth(len(stack))
        add_size(1)
        add_count(0)
        if stack:
            parent = stack[-1][0]
            add_parent(parent)
            add_idx(counts[parent])
            counts[parent] += 1
        else:
            add_parent(-1)
            add_idx(roots)
            roots += 1
        return k

    def done() -> None:
        while stack and stack[-1][1] is None:
            k = stack.pop()[0]
            sizes[k] = len(types) - k

    def leaf(kind: str, value: str, at: int) -> None:
        add(kind, value, at)
        if stack and stack[-1][1] is None:
            done()

    def string_end(at: int) -> int:
        while at < n and text[at] != '"':
            at += 2 if text[at] == "\\" else 1
        if at >= n:
            raise Unreadable("string without end")
        return at

    def begin(kind: str, close: str | None, at: int) -> None:
        stack.append((add(kind, "", at), close))

    plain = PLAIN.match
    while i < n:
        m = plain(text, i)
        i, found = m.end(), m.lastindex
        if found == 1:
            word = m[1]
            c = word[0]
            kind = "Keyword" if c == ":" else "Bool" if word in ("true", "false") else "Nil" if word == "nil" else "Number" if c.isdecimal() or (c in "+-" and word[1:2].isdecimal()) else "Symbol"
            leaf(kind, word, m.start(1))
            continue
        if found == 2:
            begin(*OPEN[m[2]], i - 1)
            continue
        if found == 3:
            if not stack or stack[-1][1] != m[3]:
                raise Unreadable(f"unexpected {m[3]}")
            k = stack.pop()[0]
            sizes[k] = len(types) - k
            if stack and stack[-1][1] is None:
                done()
            continue
        if i == n:
            break
        c = text[i]
        if c == ";" or text.startswith("#!", i):
            end = text.find("\n", i)
            end = n if end < 0 else end
            line = bisect_right(starts, i)
            out.comments.append((text[i:end].rstrip("\r"), line, i - starts[line - 1] + 1))
            i = end
        elif c == '"':
            end = string_end(i + 1)
            leaf("String", text[i + 1 : end], i)
            i = end + 1
        elif c == "~" and text.startswith("~@", i):
            begin("UnquoteSplice", None, i)
            i += 2
        elif c in PREFIX:
            begin(PREFIX[c], None, i)
            i += 1
        elif c == "^":
            i += 1
        elif c == "\\":
            m = re.compile(r"\\(?:[A-Za-z0-9]+|.)", re.S).match(text, i)
            if not m:
                raise Unreadable("character without end")
            leaf("Character", m[0], i)
            i = m.end()
        elif c == "#" and i + 1 < n:
            d = text[i + 1]
            if d == "(":
                begin("FnLiteral", ")", i)
                i += 2
            elif d == "{":
                begin("Set", "}", i)
                i += 2
            elif d == '"':
                end = string_end(i + 2)
                leaf("Regex", text[i + 2 : end], i)
                i = end + 1
            elif d == "'":
                m = TOKEN.match(text, i + 2)
                if not m:
                    raise Unreadable("var quote of no symbol")
                leaf("VarQuote", m[0], i)
                i = m.end()
            elif d == "_":
                begin("ReaderDiscard", None, i)
                i += 2
            elif d == "^":
                i += 2
            elif d == "=":
                begin("ReaderEval", None, i)
                i += 2
            elif d == "?":
                spliced = text.startswith("#?@", i)
                at = text.find("(", i)
                if at < 0 or text[i + 2 + spliced : at].strip():
                    raise Unreadable("reader conditional without branches")
                begin("ReaderCondSplice" if spliced else "ReaderCond", ")", i)
                i = at + 1
            else:
                m = TOKEN.match(text, i + 1)
                if not m:
                    raise Unreadable(f"unknown dispatch {d}")
                if d not in ":#":
                    leaf("Tag", m[0], i)
                elif d == "#":
                    leaf("Symbol", text[i : m.end()], i)
                i = m.end()
        else:  # a lone # at the end is a word
            m = TOKEN.match(text, i)
            if not m:
                raise Unreadable(f"unexpected {c}")
            leaf("Symbol", m[0], i)
            i = m.end()
    if stack:
        raise Unreadable("form without end")
    return out


def body_start(f: Forms, node: int, head: str, kids: list[int]) -> int:
    """Index of the first body form of a function-like list: behind name, dispatch value, docs and parameters."""
    i = 1 if head == "fn" else 2
    if head == "fn" and len(kids) > 1 and f.type[kids[1]] == "Symbol":
        i = 2
    if head == "defmethod":
        i = 3
    while i < len(kids) and f.type[kids[i]] in ("String", "Map"):
        i += 1
    return i + 1 if i < len(kids) and f.type[kids[i]] == "Vector" else i


def canonical(f: Forms, kids: list[list[int]], rows: Sequence[int]) -> list[str]:
    """Text of the subtrees of ``rows`` (in order) without places, spacing, comments, or the docs of definitions."""
    out = [""] * len(f.type)
    need, end = [], 0
    for k in rows:
        if k >= end:
            end = k + f.size[k]
            need.append(range(k, end))
    for k in (k for r in reversed(need) for k in reversed(r)):
        own = kids[k]
        if not own:
            out[k] = f"{f.type[k]}({f.value[k]})" if f.value[k] else f"{f.type[k]}[]"
            continue
        parts = [out[x] for x in own]
        if f.type[k] == "List" and f.value[own[0]] in FUNCTIONS and len(own) > 3 and f.type[own[2]] == "String":
            del parts[2]
        out[k] = f"{f.type[k]}[{' '.join(parts)}]"
    return [out[k] for k in rows]


def _runs(start: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of runs, and of each the number of its run."""
    of = np.repeat(np.arange(len(start)), reach)
    return np.arange(len(of)) - np.repeat(np.cumsum(reach) - reach - start, reach), of


def _entries(cols: dict[str, pa.Array], at: np.ndarray, root: np.ndarray, ends: np.ndarray, parent: np.ndarray, depth: np.ndarray) -> pa.Array:
    """Lists of entries: rows ``at``, told from their ``root``; ``ends`` are the lists' ends."""
    take = pa.array(at, pa.int64())
    fields = {
        "i": pa.array((at - root).astype(np.int32)), "p": pa.array(np.where(at == root, -1, parent[at] - root).astype(np.int32)), "d": pa.array((depth[at] - depth[root]).astype(np.int32)),
        **{x: cols[x].take(take) for x in ("k", "t", "v", "h", "n", "z", "l", "c")},
    }
    return pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), pa.StructArray.from_arrays([fields[x] for x in FIELDS], list(FIELDS)))


def marked_private(f: Forms, kids: list[list[int]], k: int) -> bool:
    return any(f.value[x] == ":private" or (f.type[x] == "Map" and any(f.value[y] == ":private" for y in kids[x])) for x in kids[k])


def node_batch(files: list[tuple[str, Forms]], deep: frozenset[str] = WIDE, whole: bool = False, heads_of: frozenset[str] | None = None) -> pa.RecordBatch:
    """Node rows of the files; comments come last in each, with negative ids and no parent. ``whole``: all lists carry all.
    ``heads_of``: rows of lists with these heads only, each as it is among all rows."""
    type_, value, line, col, parent, idx, depth, size, count, head = [], [], [], [], [], [], [], [], [], []
    picked, path, ids, enclosing, flags, ups, asts, wide = [], [], [], [], [], [], [], []
    for name, f in files:
        base, n = len(type_), len(f.type)
        heads: list[str | None] = [None] * n
        for p, j, t, v in zip(f.parent, f.idx, f.type, f.value, strict=True):
            if j == 0 and p >= 0 and t == "Symbol":
                heads[p] = v
        mine = range(n) if heads_of is None else [k for k, h in enumerate(heads) if h in heads_of and f.type[k] == "List"]
        if heads_of is not None and not mine:
            continue
        kids: list[list[int]] = [[] for _ in range(n)]
        for k, p in enumerate(f.parent):
            if p >= 0:
                kids[p].append(k)
        starts: dict[int, int] = {}
        around: dict[int, tuple[list[str], tuple[bool, ...]]] = {-1: ([], (False,) * 6)}
        for row in mine:
            up = [row]
            while f.parent[up[-1]] not in around:
                up.append(f.parent[up[-1]])
            for k in reversed(up):
                p = f.parent[k]
                names, was = around[p]
                if p < 0:
                    around[k] = names, was
                    continue
                h = heads[p] if f.type[p] in ("List", "FnLiteral") else None
                if h is not None:
                    names = [*names, h]
                    own = list(was)
                    if h in FUNCTIONS and f.type[p] == "List":
                        if p not in starts:
                            starts[p] = body_start(f, p, h, kids[p])
                        own[0] = own[0] or f.idx[k] >= starts[p]
                    if h in FLAGS and f.idx[k] >= 1:
                        own[FLAGS[h]] = True
                    was = tuple(own)
                around[k] = names, was
            enclosing.append(around[row][0])
            flags.append(around[row][1])
            p = f.parent[row]
            ups.append((f.type[p], heads[p], f.count[p]) if p >= 0 else (None, None, None))
            h, t = heads[row], f.type[row]
            wide.append(t in ("List", "FnLiteral") and (2 if whole or h in deep or t == "FnLiteral" or f.depth[row] == 0 or "/go" in (h or "") or marked_private(f, kids, row) else 1))
        type_ += f.type
        value += f.value
        line += f.line
        col += f.col
        parent += [p + base if p >= 0 else -1 for p in f.parent]
        idx += f.idx
        depth += f.depth
        size += f.size
        count += f.count
        head += heads
        picked += [base + k for k in mine]
        path += [name] * len(mine)
        ids += mine
        asts += canonical(f, kids, mine)
        for k, (text, at_line, at_col) in enumerate(f.comments if heads_of is None else ()):
            picked.append(len(type_))
            type_.append("Comment"), value.append(text), line.append(at_line), col.append(at_col), parent.append(-1), idx.append(k), depth.append(0), size.append(1), count.append(0)
            head.append(None), path.append(name), ids.append(-1 - k), enclosing.append([]), flags.append((False,) * 6), ups.append((None, None, None)), asts.append(None), wide.append(0)
    n = len(type_)
    parents, depths, sizes = np.array(parent, np.int64), np.array(depth, np.int64), np.array(size, np.int64)
    cols = {
        "k": pa.array(idx, pa.int32()), "t": pa.array(type_, pa.string()), "v": pa.array(value, pa.string()), "h": pa.array(head, pa.string()), "n": pa.array(count, pa.int32()),
        "z": pa.array(size, pa.int32()), "l": pa.array(line, pa.int32()), "c": pa.array(col, pa.int32()),
    }
    rows = np.array(picked, np.int64)
    has = parents >= 0
    kid = np.arange(n)[has][np.argsort(parents[has], kind="stable")]
    counts = np.bincount(parents[has], minlength=n).astype(np.int64)
    at, of = _runs((np.cumsum(counts) - counts)[rows], counts[rows])
    kid_lists = _entries(cols, kid[at], rows[of], np.cumsum(counts[rows]), parents, depths)
    spread = np.array(wide, np.int64)
    at, of = _runs(rows, np.where(spread > 0, sizes[rows], 0))
    keep = (spread[of] == 2) | (depths[at] - depths[rows[of]] <= SHALLOW)
    at, of = at[keep], of[keep]
    sub_lists = _entries(cols, at, rows[of], np.cumsum(np.bincount(of, minlength=len(rows))), parents, depths)
    base_of = rows - np.array(ids, np.int64)  # first row of the file, for tree rows
    ints = lambda x: pa.array(np.asarray(x, np.int32))
    own = {x: c.take(pa.array(rows)) for x, c in cols.items()}
    up = parents[rows]
    arrays = [
        pa.array(path, pa.string()), ints(ids), ints(np.where(up >= 0, up - base_of, -1)), own["k"], ints(depths[rows]), own["z"], own["t"], own["v"], own["h"], own["n"], own["l"], own["c"],
        kid_lists, sub_lists, pa.array(enclosing, pa.list_(pa.string())),
        *[pa.array([x[j] for x in flags], pa.bool_()) for j in range(6)], pa.array([u[0] for u in ups], pa.string()), pa.array([u[1] for u in ups], pa.string()), pa.array([u[2] for u in ups], pa.int32()), pa.array(asts, pa.string()),
    ]
    return pa.RecordBatch.from_arrays(arrays, [x.strip().split(" ")[0] for x in re.split(r",(?![^<]*>)", SCHEMA)])


def parse_batches(batches: Iterator[pa.RecordBatch], deep: frozenset[str] = WIDE, whole: bool = False, heads_of: frozenset[str] | None = None, most: int = 20_000) -> Iterator[pa.RecordBatch]:
    """(path, text) batches to node batches of about ``most`` rows (with ``heads_of``: made of so many), or one file if that is larger."""
    held: list[tuple[str, Forms]] = []
    rows = 0
    for b in batches:
        for path, text in zip(b.column(0), b.column(1), strict=True):
            try:
                f = read_forms(text.as_py() or "")
            except Unreadable:
                continue
            held.append((path.as_py(), f))
            rows += len(f.type) + len(f.comments)
            if rows >= most:
                yield node_batch(held, deep, whole, heads_of)
                held, rows = [], 0
    if held:
        yield node_batch(held, deep, whole, heads_of)
