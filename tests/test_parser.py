from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lispmill.sources.parser import Unreadable, node_batch, read_forms


def kinds(text):
    f = read_forms(text)
    return list(zip(f.type, f.value, strict=True))


def test_atoms():
    assert kinds('a :b "c" 1 -2.5 true nil \\x #"r"') == [("Symbol", "a"), ("Keyword", ":b"), ("String", "c"), ("Number", "1"), ("Number", "-2.5"), ("Bool", "true"), ("Nil", "nil"), ("Character", "\\x"), ("Regex", "r")]


def test_reader_forms():
    assert [t for t, _ in kinds("'a `a ~a ~@a @a #'a #_a #(f %) #{1} #?(:clj 1) #inst \"x\"")] == ["Quote", "Symbol", "SyntaxQuote", "Symbol", "Unquote", "Symbol", "UnquoteSplice", "Symbol", "Deref", "Symbol", "VarQuote", "ReaderDiscard", "Symbol", "FnLiteral", "Symbol", "Symbol", "Set", "Number", "ReaderCond", "Keyword", "Number", "Tag", "String"]


def test_metadata_is_a_sibling():
    f = read_forms("(def ^:private x 1)")
    assert f.count[0] == 4 and f.value[2] == ":private"


def test_lines_columns_comments():
    f = read_forms("; one\n(a\n  b) ; two")
    assert list(zip(f.value, f.line, f.col, strict=True)) == [("", 2, 1), ("a", 2, 2), ("b", 3, 3)]
    assert f.comments == [("; one", 1, 1), ("; two", 3, 6)]


@pytest.mark.parametrize("text", ["(a", "a)", "(a]", '"x', "#(", "#?x"])
def test_unreadable(text):
    with pytest.raises(Unreadable):
        read_forms(text)


def test_deep_nesting_needs_no_stack():
    f = read_forms("(" * 3000 + ")" * 3000)
    assert f.size[0] == 3000


tree = st.recursive(st.sampled_from(["a", ":k", "1", '"s"', "nil"]), lambda x: st.lists(x, max_size=4).map(lambda xs: "(" + " ".join(xs) + ")") | st.lists(x, max_size=3).map(lambda xs: "[" + ",".join(xs) + "]"), max_leaves=25)


@settings(max_examples=60, deadline=None)
@given(st.lists(tree, max_size=4))
def test_sizes_and_children_agree(forms):
    f = read_forms("\n".join(forms))
    n = len(f.type)
    for k in range(n):
        inside = [j for j in range(n) if k <= j and any(a == k for a in ancestors(f, j))]
        assert f.size[k] == len(inside) and f.count[k] == sum(p == k for p in f.parent)
    rows = node_batch([("p", f)]).to_pylist()
    assert [[x["i"] + r["id"] for x in r["kids"]] for r in rows] == [[j for j in range(n) if f.parent[j] == k] for k in range(n)]


def ancestors(f, j):
    while j >= 0:
        yield j
        j = f.parent[j]
