"""Declarations of nested code, by hand."""

from tidewell.operators import declarations as D

SMALL = """import { a } from './a'
import './side'
// about the shop
export class Shop<T> extends Base<T> implements Open, Closed {
  private stock: Map<string, { n: number }> = new Map()
  static count = 0;
  /* not { a } method() { */
  constructor(private readonly x = "}") { super() }
  get size() { return this.stock.size }
  async sell(item: string, how = { fast: true }): Promise<void> {
    if (item === '{') { for (;;) { break } }
    const s = `a ${item} { b`;
  }

  // second
  private buy<K>(k: K) { return () => { return k } }
}

interface Open { at: number; go(): void }
export type Pair = { a: 1 } |
  { b: 2 };
enum Size { S, M }
export default async function run(x: { y: number }) { class Inner { a() {} } return x }
const pay = async (x) => {
  return x
}
const short = 1
let long = '""" + "y" * 120 + """';
function over(a: string): void;
"""


def test_small_file():
    got = D.cut_file(SMALL)
    assert [(k, s) for k, s, *_ in got] == [
        ("class", ["Shop", "sell", "buy"]), ("interface", ["Open"]), ("type", ["Pair"]), ("enum", ["Size"]), ("function", ["run"]), ("variable", ["pay"]), ("variable", ["long"]), ("function", ["over"]),
    ]
    assert [(a, b) for _, _, a, b, _ in got] == [(4, 17), (19, 19), (20, 21), (22, 22), (23, 23), (24, 26), (28, 28), (29, 29)]
    assert got[0][4].lstrip().startswith("// about the shop\nexport class Shop") and got[0][4].endswith("return k } }\n}")
    assert got[2][4].strip() == "export type Pair = { a: 1 } |\n  { b: 2 };"


def test_large_class_is_cut():
    got = D.cut_file(SMALL, large=200)
    kinds = [k for k, *_ in got]
    assert kinds[:3] == ["class-summary", "method", "method"] and got[1][1] == ["Shop.sell"] and got[2][1] == ["Shop.buy"]
    assert got[0][4] == "\n".join([
        "export class Shop extends Base<T> implements Open, Closed {", "  private stock: Map<string, { n: number }>;", "  static count;", "",
        "  async sell(item: string, how = { fast: true }): Promise<void>;", "  private buy<K>(k: K);", "}",
    ])
    assert got[1][2:4] == (10, 13) and got[1][4].strip().startswith("async sell(") and got[1][4].endswith("b`;\n  }")
    assert got[2][4].strip() == "// second\n  private buy<K>(k: K) { return () => { return k } }"


def test_odd_texts(spark):
    for text in ("", "   \n", "}}}} class {", "class A {", "class A { b( {", "'unclosed class B {}", "/* class C { } ", "`${`class D {}`}`", "export default class { a() {} }", "x.class = 1; const y = 2"):
        D.cut_file(text)
    assert [s for _, s, *_ in D.cut_file("export default class { a() {} }")] == [["anonymous", "a"]]
    rows = D.declarations(spark.createDataFrame([("a", SMALL), ("b", None), ("c", "")], "path string, content string")).orderBy("chunk").collect()
    assert len(rows) == 8 and rows[0].imports == ["./a", "./side"] and rows[1].imports is None


def test_long_bodies_and_depths():
    body = "  if (a[0]) { b('}') }\n" * 400
    got = D.cut_file(f"const a = {{ b: [1, (2)] }}\nfunction f() {{\n{body}}}\nfunction g() {{ }}\nconst h = () => {{\n{body}")
    assert [(k, s, a, b) for k, s, a, b, _ in got] == [("function", ["f"], 2, 403), ("function", ["g"], 404, 404), ("variable", ["h"], 405, 805)]


def test_files_of_a_small_table_are_cut_by_many_tasks(spark):
    from tidewell.plans.code import k8_declarations

    assert k8_declarations(spark, "/root/testdata/sf0.01").rdd.getNumPartitions() >= 3
