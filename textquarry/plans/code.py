"""Files of code built from the rows of documents, in each language, and what there is in them, for the registered queries.

A document's first word and id name things, and its id says in which language and with how many members its file is written.
Each form lists what its lines declare by the grammar of its language, so that SQL gives the rows without any analysis.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A line: in the head, in a member or in the tail, and how far behind its first line.
Place = tuple[str, int]


@dataclass(frozen=True)
class Form:
    """{n} in a text is the document's name, {i} a member's number."""

    extension: str
    head: str
    member: str
    tail: str
    #: (symbol, line, first line, last line)
    definitions: Sequence[tuple[str, Place, Place, Place]]
    imports: tuple[Place, Place] | None = None
    #: Lines whose code says target: (line, scope's name, first line, last line).
    targets: Sequence[tuple[Place, str, Place, Place]] = ()
    #: All scopes, where a query asks for them: (first line, last line).
    scopes: Sequence[tuple[Place, Place]] = ()
    #: Damaged regions: (first line, last line, kind).
    regions: Sequence[tuple[Place, Place, str]] = ()
    #: Occurrences counted by tokens: (line, symbol, how often).
    names: Sequence[tuple[Place, str, int]] = field(default=())


def h(k: int) -> Place:
    return "h", k - 1


def m(k: int) -> Place:
    return "m", k


def t(k: int) -> Place:
    return "t", k


def _one(symbol: str, at: Place) -> tuple[str, Place, Place, Place]:
    return symbol, at, at, at


FORMS: dict[str, Form] = {}

FORMS["go"] = Form(
    "go",
    """package p

import (
	"fmt"
	"os"
)

const limit{n}, floor{n} = 10, 2

type {n} struct {
	size int // target
}

""",
    """func (r *{n}) m{i}(key string) string {
	if key == "target {" {
		return target(key)
	}
}
""",
    """var last{n} = func() int {
	return target(1)
}
""",
    [_one("limit{n}", h(8)), _one("floor{n}", h(8)), ("{n}", h(10), h(10), h(12)), ("m{i}", m(0), m(0), m(4)), ("last{n}", t(0), t(0), t(2))],
    (h(3), h(6)),
    [(m(2), "m{i}", m(0), m(4)), (t(1), "last{n}", t(0), t(2))],
)
FORMS["python"] = Form(
    "py",
    '''"""target of the module"""
import os
from pathlib import (
    Path,
)


class {n}:
    size = 1
''',
    """    def m{i}(self, key):
        # target
        return target(key) or "target"
""",
    """

async def last{n}(key):
    await target(key)
""",
    [("{n}", h(8), h(8), t(-1)), ("m{i}", m(0), m(0), m(2)), ("last{n}", t(2), t(2), t(3))],
    (h(2), h(5)),
    [(m(2), "m{i}", m(0), m(2)), (t(3), "last{n}", t(2), t(3))],
)
FORMS["rust"] = Form(
    "rs",
    """use std::collections::HashMap;
use std::fmt::{self, Display};

pub struct {n}<'a> {
    map: HashMap<&'a str, u32>,
}

impl<'a> {n}<'a> {
""",
    """    pub fn m{i}(&self, key: &str) -> u32 {
        let text = r#"target {"#; /* target /* nested */ */
        target(key, text)
    }
""",
    """}

fn r#type() -> u32 {
    target(1)
}
struct r#match;
""",
    [("{n}", h(4), h(4), h(6)), ("{n}", h(8), h(8), t(0)), ("m{i}", m(0), m(0), m(3)), ("r#type", t(2), t(2), t(4)), _one("r#match", t(5))],
    (h(1), h(2)),
    [(m(2), "m{i}", m(0), m(3)), (t(3), "r#type", t(2), t(4))],
)
FORMS["javascript"] = Form(
    "js",
    """import fs from 'fs';
import { join } from 'path';

class {n} {
""",
    """  m{i}(key) {
    const found = /target{/.test(key);
    return target(found, `text ${target} {`);
  }
""",
    """}

export const last{n} = (key) => {
  return target(key); // target
};
const once = (function inner{n}() { return 1; })();
""",
    [("{n}", h(4), h(4), t(0)), ("m{i}", m(0), m(0), m(3)), _one("found", m(1)), ("last{n}", t(2), t(2), t(4)), _one("once", t(5)), _one("inner{n}", t(5))],
    (h(1), h(2)),
    [(m(2), "m{i}", m(0), m(3)), (t(3), "last{n}", t(2), t(4))],
)
FORMS["jsx"] = Form(
    "jsx",
    """import React from 'react';

function {n}() {
  return (
    <ul title="target">
""",
    """      <li key={{i}} on={() => target({i})}>
        don't target {target({i})} { "target" }
      </li>
""",
    """      <b>{(function inner{n}() { return target(1); })()}</b> it's <br/>
    </ul>
  );
}
class After{n} {}
""",
    [("{n}", h(3), h(3), t(3)), _one("inner{n}", t(0)), _one("After{n}", t(4))],
    (h(1), h(1)),
    [(m(0), "{n}", h(3), t(3)), (m(1), "{n}", h(3), t(3)), (t(0), "inner{n}", t(0), t(0))],
)
FORMS["typescript"] = Form(
    "ts",
    """/// <reference path="lib.d.ts" />
import type { Key } from './key';

export interface I{n} {
  read(key: Key): string;
  size: number;
}

export namespace {n} {
""",
    """  export function m{i}(key: Key): string {
    return target(key);
  }
""",
    """}

enum Kind{n} { Small, Large = 2 }
type Alias{n} = string | 'target';
""",
    [("I{n}", h(4), h(4), h(7)), _one("read", h(5)), _one("size", h(6)), ("{n}", h(9), h(9), t(0)), ("m{i}", m(0), m(0), m(2)), _one("Kind{n}", t(2)), _one("Small", t(2)), _one("Large", t(2)), _one("Alias{n}", t(3))],
    (h(1), h(2)),
    [(m(1), "m{i}", m(0), m(2))],
)
FORMS["java"] = Form(
    "java",
    """package store;

import java.util.List;
import java.util.Map;

public class {n} {
    private final int limit = 10, floor = 2;

    {n}() {
        target(limit);
    }
""",
    """    /* target */
    List<String> m{i}(Map<String, String> keys) {
        return target(keys, "target {");
    }
""",
    """
    enum Kind { SMALL, LARGE }
    record Pair(int left, int right) {
        Pair {
            target(left);
        }
    }
}
""",
    [("{n}", h(6), h(6), t(7)), _one("limit", h(7)), _one("floor", h(7)), ("{n}", h(9), h(9), h(11)), ("m{i}", m(1), m(1), m(3)), _one("Kind", t(1)), _one("SMALL", t(1)), _one("LARGE", t(1)), ("Pair", t(2), t(2), t(6)), _one("left", t(2)), _one("right", t(2)), ("Pair", t(3), t(3), t(5))],
    (h(3), h(4)),
    [(h(10), "{n}", h(9), h(11)), (m(2), "m{i}", m(1), m(3)), (t(4), "Pair", t(3), t(5))],
)
FORMS["c"] = Form(
    "c",
    """#include <stdio.h>
#include "cache.h"

#define LIMIT{n} 10
#define LARGER{n}(a, b) \\
    ((a) > (b) ? (a) : (b))

typedef int (*call{n})(int);
typedef struct {n} { int size; } {n}_t;

""",
    """#ifdef WIDE{i}
static int m{i}(long key) {
#else
static int m{i}(int key) {
#endif
    /* target */
    key = 1.target + 0x1p+target;
    return target(key, "target {");
}
""",
    """#if A{n}
int last{n} = 1;
#elif B{n}
int last{n} = target;
#endif
""",
    [
        _one("LIMIT{n}", h(4)), ("LARGER{n}", h(5), h(5), h(6)), _one("call{n}", h(8)), _one("{n}", h(9)), _one("size", h(9)), _one("{n}_t", h(9)),
        ("m{i}", m(1), m(1), m(8)), _one("last{n}", t(1)), _one("last{n}", t(3)),
    ],
    (h(1), h(2)),
    [(m(7), "m{i}", m(1), m(8)), (t(3), "", t(2), t(3))],
    [(h(9), h(9)), (m(0), m(4)), (m(2), m(3)), (m(1), m(8)), (t(0), t(4)), (t(2), t(3))],
)
FORMS["cpp"] = Form(
    "cpp",
    """#include <string>

namespace store::{n} {

template <typename K>
class Cache : public Base {
 public:
  Cache() = default;
  ~Cache() {}
  explicit operator bool() const { return true; }
""",
    """  int m{i}(const K& key) const {
    return target(key, R"x(target {)x");
  }
""",
    """  void operator()(int x) {}
};

using Name = std::string;

}  // target

auto [first, second] = store::pair();
""",
    [
        ("store::{n}", h(3), h(3), t(5)), ("Cache", h(6), h(5), t(1)), _one("Cache", h(8)), _one("~Cache", h(9)), _one("operator bool", h(10)),
        ("m{i}", m(0), m(0), m(2)), _one("operator()", t(0)), _one("Name", t(3)), _one("first", t(7)), _one("second", t(7)),
    ],
    (h(1), h(1)),
    [(m(1), "m{i}", m(0), m(2))],
)
FORMS["csharp"] = Form(
    "cs",
    """extern alias Legacy;
global using System;
using System.Linq;

namespace Store
{
    public class {n}
    {
        public event System.Action Changed, Closed;
        public int Limit { get; set; }
""",
    """        public string m{i}(string key)
        {
            return target(key, $"target {target}", @"target ""{");
        }
""",
    """        public static implicit operator int({n} cache) => 1;
        enum Kind { Small, Large }
    }
}
""",
    [
        _one("Legacy", h(1)), ("Store", h(5), h(5), t(3)), ("{n}", h(7), h(7), t(2)), _one("Changed", h(9)), _one("Closed", h(9)), _one("Limit", h(10)),
        ("m{i}", m(0), m(0), m(3)), _one("implicit operator int", t(0)), _one("Kind", t(1)), _one("Small", t(1)), _one("Large", t(1)),
    ],
    (h(1), h(3)),
    [(m(2), "m{i}", m(0), m(3))],
)
FORMS["kotlin"] = Form(
    "kt",
    """package store

import java.util.Date
import kotlin.math.max

class {n}(val limit: Int, name: String) {
""",
    """    fun m{i}(key: String): String {
        return target(key, "target ${target} {")
    }
""",
    """
    fun `with spaces`() {
        target(1) // target
    }
}

enum class Kind { SMALL, LARGE }
object Stores
typealias Name = String
""",
    [("{n}", h(6), h(6), t(4)), _one("limit", h(6)), ("m{i}", m(0), m(0), m(2)), ("with spaces", t(1), t(1), t(3)), _one("Kind", t(6)), _one("SMALL", t(6)), _one("LARGE", t(6)), _one("Stores", t(7)), _one("Name", t(8))],
    (h(3), h(4)),
    [(m(1), "m{i}", m(0), m(2)), (t(2), "with spaces", t(1), t(3))],
)
FORMS["swift"] = Form(
    "swift",
    """import Foundation
import Dispatch

infix operator +++

struct {n} {
    let limit = 10
    init() {
        target(limit)
    }
""",
    """    func m{i}(_ key: Int) -> Int {
        switch key {
        case 1:
            return target(key)
        default:
            return 2
        }
    }
""",
    """    static func +++ (left: {n}, right: {n}) -> {n} {
        return target(left)
    }
}

enum Kind { case small, large }
protocol Source { func read() }
""",
    [
        _one("+++", h(4)), ("{n}", h(6), h(6), t(3)), _one("limit", h(7)), ("init", h(8), h(8), h(10)), ("m{i}", m(0), m(0), m(7)), ("+++", t(0), t(0), t(2)),
        _one("Kind", t(5)), _one("small", t(5)), _one("large", t(5)), _one("Source", t(6)), _one("read", t(6)),
    ],
    (h(1), h(2)),
    [(h(9), "init", h(8), h(10)), (m(3), "m{i}", m(0), m(7)), (t(1), "+++", t(0), t(2))],
    [(h(6), t(3)), (h(8), h(10)), (m(0), m(7)), (m(1), m(6)), (m(2), m(4)), (m(4), m(5)), (t(0), t(2)), (t(5), t(5)), (t(6), t(6))],
)
FORMS["modula-2"] = Form(
    "mod",
    """MODULE {n};
FROM Store IMPORT Open, Close;
IMPORT Files;
CONST Limit = 10;
TYPE
  Shape = RECORD
    x: INTEGER;
  END;
VAR count: INTEGER;
""",
    """PROCEDURE m{i}(key: INTEGER): INTEGER;
BEGIN
  (* target (* nested *) *)
  RETURN target(key)
END m{i};
""",
    """BEGIN
  target(1)
END {n}.
""",
    [("{n}", h(1), h(1), t(2)), _one("Limit", h(4)), ("Shape", h(6), h(6), h(8)), _one("x", h(7)), _one("count", h(9)), ("m{i}", m(0), m(0), m(4))],
    (h(2), h(3)),
    [(m(3), "m{i}", m(0), m(4)), (t(1), "{n}", h(1), t(2))],
)

# -- damaged files: what is declared beyond the damage is found, what strings and comments say is not

FORMS["go_damaged"] = Form(
    "go",
    """package p

func first{n}() {
	x(
		func inner{n}() {}
}

func open{n}() {
	if x {
		y()
""",
    """func m{i}() {
	s := "func hidden{i}()"
}
""",
    """}
// func hidden{n}()
func last{n}() {
}
""",
    [("first{n}", h(3), h(3), h(6)), _one("inner{n}", h(5)), ("open{n}", h(8), h(8), h(10)), ("m{i}", m(0), m(0), m(2)), ("last{n}", t(2), t(2), t(3))],
    regions=[(h(4), h(6), "error"), (h(10), h(10), "missing"), (t(0), t(0), "error")],
)
FORMS["java_damaged"] = Form(
    "java",
    """class {n} {
    void first() {
        if (x) {
    }

""",
    """    void m{i}() {
        String s = "class Hidden{i} {";
    }
""",
    """}
class Last{n} {
}
""",
    [("{n}", h(1), h(1), t(0)), ("first", h(2), h(2), h(4)), ("m{i}", m(0), m(0), m(2)), ("Last{n}", t(1), t(1), t(2))],
    regions=[(h(4), h(4), "missing")],
)
FORMS["rust_damaged"] = Form(
    "rs",
    """fn first{n}() {
    let x = (1;
    fn inner{n}() {}
}

""",
    """fn m{i}() {
    // fn hidden{i}() {
}
""",
    """/* left open
fn hidden{n}() {
}
""",
    [("first{n}", h(1), h(1), h(4)), _one("inner{n}", h(3)), ("m{i}", m(0), m(0), m(2))],
    regions=[(h(2), h(2), "missing"), (t(0), t(2), "error")],
)
FORMS["c_damaged"] = Form(
    "c",
    """int first{n}(void) {
  if (x) {
  y();
""",
    """int m{i}(void) {
  return 1;
}
""",
    """int last{n}(void) {
}
#if 1
""",
    [("first{n}", h(1), h(1), h(3)), ("m{i}", m(0), m(0), m(2)), ("last{n}", t(0), t(0), t(1))],
    regions=[(h(3), h(3), "missing"), (t(2), t(2), "error")],
)
FORMS["kotlin_damaged"] = Form(
    "kt",
    """class {n} {
    fun first() {
        g(
    }
""",
    """    fun m{i}() {
    }
""",
    """}
}
object Last{n}
""",
    [("{n}", h(1), h(1), t(0)), ("first", h(2), h(2), h(4)), ("m{i}", m(0), m(0), m(1)), _one("Last{n}", t(2))],
    regions=[(h(3), h(4), "error"), (t(1), t(1), "error")],
)

# -- names of several tokens, and what is part of a number

NAMES = ("Target", "Store.Target", "Store::Target", "a.a", "a::a", "operator+", "e5", "fp3", "default", "+++")
FORMS["java_names"] = Form(
    "java",
    """class {n} {
    int f() {
""",
    """        return Store. // Store.Target
            Target + Store.Target + Target();
        double d = 1.e5 + 0x1.fp3;
        a.a.a.b();
""",
    """    }
}
""",
    [("{n}", h(1), h(1), t(1)), ("f", h(2), h(2), t(0))],
    names=[(m(0), "Store.Target", 1), (m(1), "Store.Target", 1), (m(1), "Target", 3), (m(3), "a.a", 2)],
)
FORMS["cpp_names"] = Form(
    "cpp",
    """void {n}() {
""",
    """  Store::
    Target(1.Target, 0x1p+Target, 1'000'Target) + Store::Target;
  a::a :: a(1.e5);
  x.operator+(y); x.operator+=(y); operator + (y);
""",
    """}
""",
    [("{n}", h(1), h(1), t(0))],
    names=[(m(0), "Store::Target", 1), (m(1), "Store::Target", 1), (m(1), "Target", 2), (m(2), "a::a", 2), (m(3), "operator+", 2)],
)
FORMS["csharp_names"] = Form(
    "cs",
    """class {n} {
    void F() {
""",
    """        Store /* Store.Target */ .
            Target(1.Target, 1.5e5, "Store.Target", @Target);
""",
    """    }
}
""",
    [("{n}", h(1), h(1), t(1)), ("F", h(2), h(2), t(0))],
    names=[(m(0), "Store.Target", 1), (m(1), "Target", 3)],
)
FORMS["swift_names"] = Form(
    "swift",
    """func {n}() {
""",
    """    let x = y.default + `default`
    a +++ b ++++ c
    Store
        .Target()
""",
    """}
""",
    [("{n}", h(1), h(1), t(0))],
    names=[(m(0), "default", 2), (m(1), "+++", 1), (m(2), "Store.Target", 1), (m(3), "Target", 1)],
)
FORMS["c_names"] = Form(
    "c",
    """int {n}(void) {
""",
    """  return 1.Target + .5e+Target + 0xTarget + Target - 1e5x;
""",
    """}
""",
    [("{n}", h(1), h(1), t(0))],
    names=[(m(0), "Target", 1)],
)

KINDS = list(FORMS)


def code_files(documents: DataFrame) -> DataFrame:
    """(path, content): the code of each document."""
    kind, count = F.col("doc_id") % len(KINDS), (F.floor(F.col("doc_id") / len(KINDS)) % 4 + 1).cast("int")
    name = F.concat(F.lit("N"), F.col("doc_id").cast("string"), F.regexp_extract(F.coalesce("text", F.lit("")), "[a-z]{3,}", 0))

    def content(form: Form) -> Column:
        members = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.replace(F.lit(form.member), F.lit("{i}"), i.cast("string")))
        return F.replace(F.concat(F.lit(form.head), F.array_join(members, ""), F.lit(form.tail)), F.lit("{n}"), name)

    path, text = F.lit(None).cast("string"), F.lit(None).cast("string")
    for k, form in enumerate(FORMS.values()):
        path = F.when(kind == k, F.concat(F.lit("src/doc_"), F.col("doc_id").cast("string"), F.lit(f".{form.extension}"))).otherwise(path)
        text = F.when(kind == k, content(form)).otherwise(text)
    return documents.where("doc_id IS NOT NULL").select(path.alias("path"), text.alias("content"))


SOURCES = f"code AS (SELECT 'src/doc_' || doc_id AS stem, doc_id % {len(KINDS)} AS kind, 'N' || doc_id || regexp_extract(coalesce(text, ''), '[a-z]{{3,}}', 0) AS n, CAST(doc_id // {len(KINDS)} % 4 + 1 AS INTEGER) AS k FROM documents WHERE doc_id IS NOT NULL)"


def rows_sql(rows_of: Callable[[Form], Sequence[tuple]], columns: str) -> str:
    """SQL for what the forms list: places become lines, texts have their names and numbers filled in."""

    def said(form: Form, x: object) -> str:
        heads, lines = form.head.count("\n"), form.member.count("\n")
        if isinstance(x, tuple):
            first = {"h": "1", "m": f"{heads} + i * {lines} + 1", "t": f"{heads} + k * {lines} + 1"}[x[0]]
            return f"CAST({first} + {x[1]} AS INTEGER)"
        return str(x) if isinstance(x, int) else f"replace(replace('{x}', '{{n}}', n), '{{i}}', CAST(i AS VARCHAR))"

    parts = []
    for k, form in enumerate(FORMS.values()):
        for row in rows_of(form):
            each = any(isinstance(x, tuple) and x[0] == "m" for x in row)
            members = "range(k)" if each else "[0]"
            cells = ", ".join(f"{said(form, x)} AS {c}" for x, c in zip(row, columns.split(", "), strict=True))
            parts.append(f"SELECT stem || '.{form.extension}' AS path, {cells} FROM (SELECT *, CAST(unnest({members}) AS INTEGER) AS i FROM code WHERE kind = {k})")
    return f"WITH {SOURCES} SELECT DISTINCT * FROM (" + " UNION ALL ".join(parts) + ")"
