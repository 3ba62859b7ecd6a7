"""Symbols of JavaScript and TypeScript against graphs written by hand."""

from gleanery.operators import symbols as S

SERVICE = """import { DatabaseConnector } from "./database.js";

export interface UserRecord {
  id: string;
}

export class UserService extends DatabaseConnector {
  async findUser(id: string) {
    return this.query(id);
  }

  private mapRow(row: unknown) {
    return row;
  }
}

export const createUserService = () => new UserService();"""

MIXED = """#!x
// class Commented { }
/* export function alsoCommented() {
} */
import def, * as ns from 'mod-a'
import type { T1, T2 as Alias } from "mod-b";
import { type T3, b } from "./b";
import "side-effect";
export { one, two as three } from "./re";
export * from './all'
export default class Base<T extends Map<string, number>> extends ns.Root<T> implements I1<A, B>, x.I2 {
  static count = 0
  handler = (a) => { return "}" }
  constructor(private readonly x: number) { super() }
  get size(): number { return 1 }
  @dec({ a: 1 }) protected async run<T>(a: { b: string }, c = `${a} } {`): Promise<{ ok: boolean }> {
    if (a) { return { ok: true } } else { return { ok: false } }
  }
  public abstract later(): void;
  #secret() { }
  'quoted'() { }
  *items() { yield 1 }
}
async function helper() {
  const inner = 1; function nested() { }
  class Local { m() { } }
}
export type Shape = { a: number } | { b: string };
type Pair<A> =
  [A, A]
export enum Color { Red, Green = "}" }
const enum Tiny { A }
let first = 1, second = { a: [1, 2] },
  third
export const { picked } = obj;
var last: Map<string, number> = new Map(), done = () => {
  return 1
}
for (const i of list) { helper() }
class Second { m() { } } class Third { }
"""


def frame(spark, *texts):
    return spark.createDataFrame([(i, "a.ts", t) for i, t in enumerate(texts)], "id long, source string, content string").repartition(2)


def test_reference_example(spark):
    f = frame(spark, SERVICE)
    d = [(r.name, r.kind, r.exported, r.visibility, r.parent, r.start_line, r.end_line, r.extends) for r in S.declarations(f).orderBy("ord").collect()]
    assert d == [
        ("UserRecord", "interface", True, "module", None, 3, 5, None), ("UserService", "class", True, "module", None, 7, 15, ["DatabaseConnector"]), ("findUser", "method", True, "module", "UserService", 8, 10, None),
        ("mapRow", "method", False, "private", "UserService", 12, 14, None), ("createUserService", "variable", True, "module", None, 17, 17, None),
    ]
    s = S.summary(f).first()
    assert (s.language, s.imports, s.n_declarations) == ("typescript", ["./database.js"], 5)
    assert s.exports == ["UserRecord", "UserService", "findUser", "createUserService"]
    assert s.public_surface == ["UserRecord", "UserService", "findUser", "UserService.findUser", "createUserService"]
    assert s.dependency_hints == ["DatabaseConnector", "./database.js", "UserService"]


def test_declarations(spark):
    got = [(r.name, r.kind, r.exported, r.visibility, r.parent, r.start_line, r.end_line, r.is_async) for r in S.declarations(frame(spark, MIXED)).orderBy("ord").collect()]
    assert got == [
        ("Base", "class", True, "module", None, 11, 23, None), ("run", "method", False, "protected", "Base", 16, 18, True), ("later", "method", True, "public", "Base", 19, 19, False),
        ("#secret", "method", True, "module", "Base", 20, 20, False), ("'quoted'", "method", True, "module", "Base", 21, 21, False), ("items", "method", True, "module", "Base", 22, 22, False),
        ("helper", "function", False, "module", None, 24, 27, True), ("Shape", "type", True, "module", None, 28, 28, None), ("Pair", "type", False, "module", None, 29, 30, None),
        ("Color", "enum", True, "module", None, 31, 31, None), ("Tiny", "enum", False, "module", None, 32, 32, None), ("first", "variable", False, "module", None, 33, 33, None), ("second", "variable", False, "module", None, 33, 33, None),
        ("third", "variable", False, "module", None, 34, 34, None), ("last", "variable", False, "module", None, 36, 36, None), ("done", "variable", False, "module", None, 36, 38, None),
        ("Second", "class", False, "module", None, 40, 40, None), ("m", "method", True, "module", "Second", 40, 40, False), ("Third", "class", False, "module", None, 40, 40, None),
    ]


def test_edges(spark):
    f = frame(spark, MIXED)
    i = [(r.source, r.bindings, r.locals, r.type_only) for r in S.imports(f).orderBy("ord").collect()]
    assert i == [("mod-a", ["def", "* as ns"], ["def", "ns"], False), ("mod-b", ["T1", "T2 as Alias"], ["T1", "Alias"], True), ("./b", ["T3", "b"], ["T3", "b"], False), ("side-effect", [], [], False)]
    assert [(r.names, r.source) for r in S.re_exports(f).orderBy("ord").collect()] == [(["one", "three"], "./re"), ([], "./all")]
    e = {(r.source, r.target, r.kind) for r in S.edges(f).collect()}
    assert e >= {("Base", "ns.Root", "extends"), ("Base", "I1", "implements"), ("Base", "x.I2", "implements"), ("run", "Base", "member"), (None, "mod-b", "imports"), (None, "./all", "re-exports")}
    assert not any(x[0] in ("Local", "nested") or x[1] in ("Local", "nested") for x in e)


def test_chunks_and_caps(spark):
    many = "\n".join(f"export function f{k}() {{\n}}" for k in range(30))
    f = frame(spark, many, SERVICE, "", "a.b('x').c()")
    s = {r.id: r for r in S.summary(f.union(spark.createDataFrame([(9, "x.py", "class A: pass")], f.schema))).collect()}
    assert set(s) == {0, 1, 2, 3} and s[0].n_declarations == 24 and s[0].exports == [f"f{k}" for k in range(12)] and s[3].n_declarations == s[2].n_declarations == 0
    c = spark.createDataFrame([(0, "a", 5, 12), (0, "b", 0, 0), (0, "c", 200, 900), (1, "d", 9, 9), (1, "e", 15, 17), (1, "f", 6, 6)], "id long, chunk_id string, start_line long, end_line long")
    got = {}
    for block in (64, 2):
        got[block] = {}
        for r in S.of_chunks(S.declarations(f), c, block).orderBy("chunk_id", "n").collect():
            got[block].setdefault(r.chunk_id, []).append(r.name)
    assert got[64] == got[2] == {"a": ["f2", "f3", "f4", "f5"], "b": [f"f{k}" for k in range(8)], "d": ["UserService", "findUser"], "e": ["UserService", "createUserService"]}
