"""Both sides are texts of the language and must be the same value."""

import http.server
import io
import os
import socket
import struct
import tarfile
import threading
import zipfile

import pytest

from setweave.lang.engine import Engine
from setweave.lang.values import EvalError, Tup, show, true, value
from setweave.operators.relation import Rel
from setweave.sources import formats

SAME = [
    ("{|a,b,c| (1,4,2)}", "{|a,b| (1,4),(2,5)} <&> {|b,c| (4,2),(6,7)}"),
    ("{|a,c| (1,7)}", "{|a,b| (1,4),(2,5)} <-> {|b,c| (4,7),(6,7)}"),
    ("{|b| (4)}", "{|a,b| (1,4),(2,5)} -&- {|b,c| (4,7),(6,7)}"),
    ("true", "{|a,b| (1,4)} --- {|b,c| (4,7)}"),
    ("{|a,b| (1,4)}", "{|a,b| (1,4),(2,5)} <&- {|b,c| (4,7)}"),
    ("{|b,c| (4,7)}", "{|a,b| (1,4),(2,5)} -&> {|b,c| (4,7)}"),
    ("{|a| (1)}", "{|a,b| (1,4),(2,5)} <-- {|b,c| (4,7)}"),
    ("{|c| (7)}", "{|a,b| (1,4),(2,5)} --> {|b,c| (4,7)}"),
    ("{|x,y| (1,{2,3}),(2,{4})}", "{|x,y| (1,2),(1,3),(2,4)} nest y"),
    ("{|a,g| (1,{|b| (1),(2)}),(2,{|b| (1)})}", "{|a,b| (1,1),(1,2),(2,1)} nest |b|g"),
    ("{|a,b| (1,1),(1,2)}", "{|a,b| (1,1),(1,2)} nest |b|g unnest g"),
    ("6", "{|a,b| (3,1),(2,2),(1,3)} sum .a"),
    ("42.5", "{41,42,43,44} median ."),
    ("{|x,r| (1,0),(2,1),(3,2)}", "{|x| (1),(2),(3)} rank (r: .x)"),
    ("[3,2,1]", "{1,2,3} orderby -."),
    ("{2,4}", "{1,2} => . * 2"),
    ("[2,,4]", "[1,,2] >> . * 2"),
    ("{'a': 2}", "{'a': 1} >> . + 1"),
    ("(a: 2, b: 3)", "(a: 1, b: 2) :> . + 1"),
    ("{1, 4}", "{1,2,3,4} where . % 3 = 1"),
    ("'abcdef'", "'abc' ++ 'def'"),
    ("(a: 1, c: 3)", "(a: 1, b: 2, c: 3).|a,c|"),
    ("(c: 3)", "(a: 1, b: 2, c: 3).~|a,b|"),
    ("(a: 1, b: 3)", "(a: 1, b: 2) +> (b: 3)"),
    ("1", "-7 % 3 + 2"),
    ("512", "2 ^ 3 ^ 2"),
    ("-4", "-7 // 2"),
    ("5", "let [a, ...t] = [2, 3]; a + t(0)"),
    ("3", "cond [1, 2] {[a]: a, [a, b]: a + b}"),
    ("{}", "cond {1 > 2: 5}"),
    ("7", "{'k': 7}('k')"),
    ("9", "{'k': 7}('z')?:9"),
    ("3", "(a: 1).b?:3"),
    ("{1,3,5}", "//bits.set(42)"),
    ("['', 'x', '', 'yz']", "//seq.split('-')('-x--yz')"),
    ("{}", "//seq.split('')('')"),
    ("'a-b'", "//seq.join('-')(['a','b'])"),
    ("120", "//fn.fix(\\f \\n cond {n < 2: 1, _: n * f(n - 1)})(5)"),
    ("true", "{1,2} (<) {1,2,3} && 1 < 2 < 3 && 2 <: {2} && !({3} (<=) {1})"),
    ("8", "(^{1,2,3}) count"),
    ("3", "1 -> \\x x + 2"),
    ("0", "{} count"),
    ("[3,2,1]", "{1,2,3} order \\a \\b a > b"),
    ("{}", "{} order \\a \\b a < b"),
    ("'<000099>'", '$"<${9 * 11:06d}>"'),
    ("'(0007/0040)'", '$"(${[7, 40]:04d:/})"'),
    ("'2.7'", "$'${//math.e:.1f}'"),
    ("'--  q--'", "$\"--${$'  q'}--\""),
    ("'top\\n\\nend'", "$'top\\n   ${{}}\\nend'"),
    ("'{(k: 1), (k: 2)}'", "$'${{(k: 2), (k: 1)}}'"),
    ("'a\\nb\\n  c'", "$'\n  a\n  b\n    c'"),
    ("'x: 12;y'", "$`x: ${(a: [1, 2]).a:::;}y`"),
    ("'1-2!'", "$'${[1, 2]::-:!}'"),
    ("(x: 6, y: 7)", "let (w: 5, ...others) = (w: 5, x: 6, y: 7); others"),
    ("[10, (name: 'n')]", "let (?:size:10, ...t) = (name: 'n'); [size, t]"),
    ("['z', 0]", "let (p: l, q?: r:0) = (p: 'z'); [l, r]"),
    ("1", "let (?:a:1) = {}; a"),
    ("{'k': 2}", "let {'a': 1, ...t} = {'a': 1, 'k': 2}; t"),
    ("9", "let f = \\x x + @y; let (@y: 4); f(5)"),
    ("'1 UP 2 LOW'", "//re.compile(`[a-z]+`).subf(//str.upper, '1 up 2 low')"),
    ("'1,2'", "//re.compile(`(\\w)=(\\d)`).sub(`$2`)('a=1,b=2')"),
    ("true", "//test.assert.size(2, {1, 2})"),
    ("(a: (b: 1, c: 5), d: 3)", "(a: (b: 1, c: 2), d: 3) +> (a+>: (c: 5))"),
    ("(a: (b: (x: 1, y: 2)), s: {1, 2}, t: 'uv')", "(a: (b: (x: 1)), s: {1}, t: 'u') +> (a+>: (b+>: (y: 2)), s|: {2}, t++: 'v')"),
    ("'007'", "//str.expand('03d', 7, '', '')"),
    ("true", "{1} !(<=) {2} && {1, 2} (<>) {1} && {1, 2} (<>=) {1, 2} && {1, 2} !(<>) {3} && {3} !(<>=) {4} && {5} !(>) {5}"),
    ("{}", "{1, 2} (<>) {1, 2}"),
    ("{'even', 'odd'}", "{1, 2, 3, 5} filter . % 2 {0: 'even', 1: 'odd'}"),
    ("{10}", "{(a: 1, b: 10), (a: 2, b: 20)} filter .a {1: .b}"),
    ("{8, 9}", "{7, 8, 9} filter . {(8, 9): .}"),
    ("{{2, 3}, {4}}", "{{1, 2}, {3}} => => . + 1"),
    ("{[2, 3]}", "{[1, 2]} => >> . + 1"),
    ("{(a: 2)}", "{(a: 1)} => :> . + 1"),
    ("2\\[5, 6]", "1\\(1\\[5, 6])"),
    ("2\\[1]", "[, , 1, , ]"),
    ("<<'ab', 10>>", "<<97, 'b', 10>>"),
    ("7", "let f = &(3 + 4); *f"),
    ("7", "(&x: 3 + 4).x"),
    ("[3, 9, 9, 9]", "[(a: (b: 3)).a?.b:9, (a: (c: 3)).a?.b?:9, (a: (c: 3)).z?.b:9, (a: {'k': 5}).a?('j')?:9]"),
    ("%c", "(2\\[%b, %c])(3)"),
    ("4\\'yz'", "'uvwxyz' where .@ > 3"),
    ("1\\[20, , 40]", "[10, 20, 30, 40] where .@item != 10 && .@item != 30"),
    ("[[1\\'a1', 2\\'1'], [3\\'b2', 4\\'2']]", "//re.compile(`[ab](\\d)`).match(':a1b2')"),
    ("[['p', 'p'], [1\\'q', , 1\\'q']]", "//re.compile('(p)|(q)').match('pq')"),
    ("'(\n  a: 1,\n  b: [1, , {2}],\n  c: {\n    3: (),\n  },\n)'", "//fmt.pretty((b: [1, , {2}], a: 1, c: {3: ()}))"),
    ("'{\n  |a, b|\n  (1, 2),\n  (3, 4),\n}'", "//fmt.pretty({|a, b| (3, 4), (1, 2)})"),
    ("[true, {}]", "let t = //fn.fixt((even: \\t \\n cond {n = 0: true, _: t.odd(n - 1)}, odd: \\t \\n cond {n = 0: {}, _: t.even(n - 1)})); [t.even(6), t.even(7)]"),
    ("{1, 2, 3}", "//rel.union({{1}, {2, 3}})"),
    ("-6", "//util.reduce(\\a \\x a - x, 0, [1, 2, 3])"),
    ("(a: (b: 1, c: 2), d: 4)", "//util.merge((a: (b: 1), d: 3), (a: (c: 2), d: 4))"),
    ("['a2', 'a10']", "//util.natural_order({'a10', 'a2'})"),
    ("{'x': {'a.txt': '1'}}", "//util.filter_tree(\\p p(0) = 'x', {'x': {'a.txt': '1'}, 'y': {'b.txt': '2'}})"),
    ("'| a | b |\n|---|---|\n| 1 | x |\n'", "//table.markdown({|a, b| (1, 'x')})"),
    ("'<table><tr><th>a</th></tr><tr><td>1 &lt; 2</td></tr></table>'", "//table.html({|a| ('1 < 2')})"),
    ("8", "//eval.evaluator((scope: (x: 5))).eval('x + 3')"),
    ("(a: [1, (b: 'c')])", "//json.tuplify(//json.simplify(//encoding.json.decode('{\"a\": [1, {\"b\": \"c\"}]}')))"),
    ("[['a', 'x\n#y'], ['1', '2']]", "//encoding.csv.decoder((comment: %#))('a,\"x\n#y\"\n#left out\n1,2\n')"),
    ("[['a', 'b'], ['1']]", "//encoding.csv.decoder((fieldsPerRecord: -1))('a,b\n1\n')"),
    ("<<'a;b\r\n'>>", "//encoding.csv.encoder((comma: %;, crlf: true))([['a', 'b']])"),
    ("[(xmldecl: 'version=\"1.0\"'), (elem: 'r', attrs: {(name: 'k', value: 'v')}, children: ['t', (comment: 'c'), (elem: 'e')])]", "//encoding.xml.decode('<?xml version=\"1.0\"?><r k=\"v\">t<!--c--><e/></r>')"),
    ("[(elem: 'r', children: [(elem: 'e', ns: 'u', attrs: {(name: 'p', ns: 'xmlns', value: 'u')})])]", "//encoding.xml.decoder((trimSurroundingWhitespace: true))('<r> <p:e xmlns:p=\"u\"/> </r>')"),
    ("<<'<r k=\"&lt;\">a &amp; b<e></e></r>'>>", "//encoding.xml.encode(//encoding.xml.decode('<r k=\"&lt;\">a &amp; b<e/></r>'))"),
    ("(r: (@k: 'v', e: ['1', '2']))", "//xml.to_tuple(//encoding.xml.decode('<r k=\"v\"><e>1</e><e>2</e></r>'))"),
    ("<<'{\"a\":\"\\\\u003c\"}'>>", "//encoding.json.encoder((escapeHTML: true))({'a': (s: '<')})"),
    ("<<'{\n>  \"a\": 1\n>}'>>", "//encoding.json.encoder((prefix: '>', indent: '  '))({'a': 1})"),
    ("<<'a:\n   b: 1\n'>>", "//encoding.yaml.encoder((indent: 3))({'a': {'b': 1}})"),
    ("[2, 'x', '[1,2]', {}]", 'let t = `{"a": [1, 2], "b": {"c": "x"}}`; [//json.number(`$.a[1]`, t), //json.text(`$.b.c`, t), //json.text(`$.a`, t), //json.text(`$.z.y`, t)]'),
    ("[{1, 5}, {2}, {2, 3}]", "{{2}, {2, 3}, {1, 5}} orderby ."),
    ("['b', 'ab', 'a']", "{'a', 'b', 'ab'} orderby -."),
    ("[(a: 1, b: 2), (a: 2), (b: 0)]", "{(b: 0), (a: 2), (a: 1, b: 2)} orderby ."),
    ("[{|a| (3)}, {|a| (1), (2)}, {|b| (0)}]", "{{|b| (0)}, {|a| (1), (2)}, {|a| (3)}} orderby ."),
    ("(name: 'v', n: 3, args: ['rest'])", "//flag.parser({'name': (type: 'string', alias: 'm'), 'n': (type: 'number')}).parse(['-m', 'v', '--n', '3', 'rest'])"),
    ("(@neg: {1})", "-{1}"),
    ("true", "//seq.contains({}, 'abc')"),
    ("[1, 2]", "//log.printf('%s and %d', [1, 2])"),
]


@pytest.mark.parametrize("expected, code", SAME)
def test_same(expected, code):
    assert Engine().eval(code) == Engine().eval(expected)


@pytest.mark.parametrize("code", ["{} max .", "{1,2} single", "[1](5)", "(a: 1).|b|", "nothing", "{|a,b| (1)}", "{'a': 1}('b')", "//test.assert.equal(1, 2)", "let (a: 1) = (a: 1, b: 2); 3", "$'${1::,}'", "@y", "{1, 2} >> .", "(a: 1).b?.c?.d:(2).e", "//encoding.csv.decode('a,b\n1\n')", "//encoding.csv.decode('a\"b')", "//encoding.xml.decode('<a>')", "<<300>>", "'a'\\[1]", "//flag.parser({}).parse(['--x'])"])
def test_errors(code):
    with pytest.raises(EvalError):
        Engine().eval(code)


def rows(rel):
    return sorted(tuple(r) for r in rel.df.select(*sorted(rel.names)).collect())


@pytest.mark.parametrize("op", ["<&>", "<->", "-&-", "<&-", "-&>", "<--", "-->", "---"])
def test_joins_on_spark_are_the_local_ones(spark, op):
    left, right = [(1.0, 4.0), (2.0, 5.0), (3.0, 4.0), (3.0, 4.0)], [(4.0, 7.0), (4.0, 8.0), (6.0, 7.0)]
    engine = Engine(spark)
    engine.bind("A", Rel.of(spark, "a double, b double", left))
    engine.bind("B", Rel.of(spark, "b double, c double", right))
    got = engine.eval(f"A {op} B")
    lit = lambda h, r: "{|" + h + "| " + ",".join(str(t) for t in r) + "}"
    local = Engine().eval(f"{lit('a,b', left)} {op} {lit('b,c', right)}")
    assert rows(got) == sorted(tuple(t[k] for k in sorted(t)) for t in local)


def test_text_over_relations(spark):
    engine = Engine(spark)
    engine.bind("R", Rel.of(spark, "k string, x double", [("a", 1.0), ("a", 2.0), ("b", 5.0), ("b", 5.0)]))
    assert rows(engine.eval("R nest ~|k|g => (k: .k, s: .g sum .x, n: .g count)")) == [("a", 2.0, 3.0), ("b", 1.0, 5.0)]
    assert rows(engine.eval("R where .x / 0 > 1 => (:.k)")) == [("a",), ("b",)]
    assert engine.eval("R sum .x") == 8.0 and engine.eval("R count") == 3.0
    assert rows(engine.eval("R rank (r: -.x) where .r < 1")) == [("b", 0.0, 5.0)]
    plan = engine.eval("R nest ~|k|g => (k: .k, s: .g sum .x)").df._jdf.queryExecution().toString()
    assert "collect_set" not in plan


def test_the_language_over_relations(spark):
    """The same texts over local relations and over Spark's give the same rows."""
    data = [("a", 1.0, [1.0, 2.0], "x y"), ("a", 2.0, [3.0], "y"), ("b", 5.0, [4.0, 5.0, 9.0], "z y x"), ("c", 7.0, [8.0, 1.0], "y z")]
    engine, local = Engine(spark), Engine()
    for e in (engine, local):
        e.bind("T", Rel.of(spark, "k string, x double, l array<double>, w string, g array<double>", [(*r, sorted(r[2])) for r in data]) if e is engine else {Tup(k=k, x=x, l=tuple(l), w=w, g=frozenset(l)) for k, x, l, w in data})
        e.bind("S", Rel.of(spark, "`@` double, v double", [(0.0, 3.0), (2.0, 4.0)]) if e is engine else {Tup({"@": 0.0, "v": 3.0}), Tup({"@": 2.0, "v": 4.0})})
    same = [
        "T filter .k {'a': (x: .x), ('b', 'c'): (x: .x + 100)}", "T filter .l {[a, b]: (p: a, q: b), [a, ...t]: (p: a, q: 0 - (t count))}", "T => (:.k, m: .g median ., s: .g => . * 2 sum ., a: .g mean ., z: .g max -.)",
        "T => (:.k, c: (.g where . > 2 && . < 9) count)", "T => (:.x, h: //seq.contains([5], .l), p: //seq.has_prefix('x', .w), t: //str.title(.w))", "S >> . + 1", "S >>> \\i \\v i + v",
        "T rank (r: -.x) where .r < 2 => (:.k, :.r)", "T rank (r: .k) where .r <= 1 => (:.x, :.r)", "(T nest ~|k|g => (:.k, g: .g rank (r: -.x))) unnest g => (:.x, :.r)", "T => (:.x, z: .q?.r?:3)",
        "T => (:.x, u: .l(0) + .l(9)?:0.5)", "T => (:.x, c: {.x} (<=) {1, 2}, d: {.x} (<>) {1, 7}, e: {.x} !(<) {1, 2})", "T where !(.x = 1) && .x <: {1, 2, 5} => (:.k)", "T => (:.x, o: (.g orderby -.)(0), i: (.l >>> \\i \\v i * v)(0))",
        "(T => (:.k)) | (T => (k: .w))", "//rel.union({T => (:.k), T => (k: .w)})", "T => (:.x, s: //seq.sub('y', .k, .w))", "T => (:.x, r: //seq.repeat(2, .k), j: //seq.trim_suffix(.k, 'ba'))",
        "let f = \\a a * 10; T => (v: f(.x))", "T => (:.x, p: .g => . + 1 sum .)", "T -> (. where .x > 1) => (:.x)",
    ]
    for text in same:
        got = engine.eval(text)
        names = sorted(got.names)
        want = sorted(tuple(value(t[n]) for n in names) for t in local.eval(text))
        assert sorted(tuple(value(r[n]) for n in names) for r in got.df.collect()) == want, text
    items = engine.eval("T order \\a \\b a.x > b.x").df.first()["items"]
    assert [r.x for r in items] == [7.0, 5.0, 2.0, 1.0]
    member = "(k: 'a', x: 2) <: (T => (:.k, :.x))"
    assert true(engine.eval(member)) and true(local.eval(member)) and not true(engine.eval("(k: 'z', x: 2) <: (T => (:.k, :.x))"))
    assert true(engine.eval("(T where .x > 1) (<>) T")) and not true(engine.eval("T (<>) T")) and true(engine.eval("T (<>=) T && T !(<) T"))
    for text in ("T % T", "T < T", "T >> .", "T filter . {{1: 2}: 3}"):
        with pytest.raises(EvalError):
            engine.eval(text)
    plan = engine.eval("T rank (r: -.x) where .r < 2").df._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_templates_over_relations(spark):
    engine = Engine(spark)
    engine.bind("R", Rel.of(spark, "k string, x double", [("a", 1.0), ("b", 2.5), ("b", 2.5)]))
    assert rows(engine.eval("R => (t: $'${.k}=${.x}', u: $'${.x * 2:03d}')")) == [("a=1", "002"), ("b=2.5", "005")]


def test_imports_and_formats(spark, tmp_path):
    (tmp_path / "lib").mkdir()
    (tmp_path / "a.csv").write_text("k,n\nx,1\n")
    (tmp_path / "lib" / "twice.sw").write_text("let d = //{./two.json}; \\x x * d('n')")
    (tmp_path / "lib" / "two.json").write_text('{"n": 2}')
    (tmp_path / "loop.sw").write_text("//{./loop} + 1")
    (tmp_path / "raw.txt").write_text("[1]")
    spark.range(3).selectExpr("cast(id as double) AS id").write.parquet(str(tmp_path / "t.parquet"))
    engine = Engine(spark, folder=str(tmp_path))
    assert engine.eval("//{./a.csv}") == (("k", "n"), ("x", "1"))
    assert engine.eval("//{/lib/twice}(21)") == 42.0
    assert engine.eval("//{./t.parquet} sum .id") == 3.0
    assert engine.eval("//[//encoding.json]{./raw.txt}") == engine.eval("(a: [1])")
    assert engine.eval("//encoding.json.decode('[1]')") == engine.eval("(a: [1])")
    assert engine.eval("//encoding.csv.decoder((comma: ';'))('a;b')") == (("a", "b"),)
    assert engine.eval("//eval.value('1 + 2')") == 3.0
    for text in ("//{./loop}", "//{./nothing}", "//{https://example.org/x.json}", "//encoding.json.other"):
        with pytest.raises(EvalError):
            engine.eval(text)
    with pytest.raises(EvalError):
        Engine(safe=True).eval("//os.file('/etc/hosts')")


def test_files_and_http(tmp_path, monkeypatch):
    """The tree of a folder, standard input read once, wire texts, and requests to a server of this machine."""
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "f.txt").write_text("12345")
    engine = Engine()
    tree = engine.eval(f"//os.tree('{tmp_path}') => .|name,size,is_dir| where .name = 'f.txt' || .name = 'd' => (:.name, :.is_dir)")
    assert tree == {Tup(name="f.txt", is_dir=frozenset()), Tup(name="d", is_dir=frozenset([Tup()]))}
    monkeypatch.setattr("sys.stdin", io.TextIOWrapper(io.BytesIO(b"in")))
    assert engine.eval("//os.stdin") == engine.eval("//os.stdin") == b"in"
    for x in (engine.eval("{1, {2}, (a: [1, 2], b: 'c')}"), engine.eval("[{3}]")):
        assert formats.from_wire(formats.to_wire(x)) == x

    class Answers(http.server.BaseHTTPRequestHandler):
        def do_GET(self, body=b"got"):
            self.send_response(200 if self.path == "/here" else 404)
            self.end_headers()
            self.wfile.write(body + self.headers.get("X-Own", "").encode())

        def do_POST(self):
            self.do_GET(self.rfile.read(int(self.headers["Content-Length"])))

        def log_message(self, *_):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Answers)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}"
    got = engine.eval(f"//net.http.get((header: (`X-Own`: ['!'])), '{url}/here')")
    assert got["status_code"] == 200.0 and got["body"] == b"got!"
    assert engine.eval(f"//net.http.get((), '{url}/gone').status_code") == 404.0 and engine.eval(f"//net.http.post((), '{url}/here', 'sent').body") == b"sent"
    server.shutdown()
    with pytest.raises(EvalError):
        Engine(safe=True).eval(f"//net.http.get((), '{url}')")


def test_command_line(tmp_path, capsys):
    from setweave.__main__ import main

    main(["eval", "{3, 1} | {2}"])
    main(["eval", "'plain'"])
    (tmp_path / "q.sw").write_text("let f = \\x x + 1; f(1)")
    main(["run", str(tmp_path / "q.sw")])
    main(["eval", "{'a': {'b.txt': 'text'}}", f"--out=dir:{tmp_path}/tree"])
    assert capsys.readouterr().out == "{1, 2, 3}\nplain\n2\n"
    assert (tmp_path / "tree" / "a" / "b.txt").read_text() == "text"


def test_sheets(tmp_path):
    """Shared and inline strings, numbers, merged cells, blank rows and columns; a second sheet with its head further down."""
    cell = lambda at, kind, x: f'<c r="{at}" t="inlineStr"><is><t>{x}</t></is></c>' if kind == "i" else f'<c r="{at}"{" t=" + chr(34) + "s" + chr(34) if kind == "s" else ""}><v>{x}</v></c>'
    sheet = lambda cells, more="": f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData><row>{"".join(cell(*c) for c in cells)}</row></sheetData>{more}</worksheet>'
    one = [("A1", "s", 0), ("B1", "i", "Unit Price"), ("D1", "i", "n"), ("A2", "s", 1), ("B2", "n", 2.5), ("D2", "n", 1), ("B5", "n", 3), ("D5", "n", 2)]
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("xl/sharedStrings.xml", '<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><si><t>Name</t></si><si><r><t>ab</t></r><r><t>c</t></r></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", sheet(one, '<mergeCells><mergeCell ref="A2:A5"/></mergeCells>'))
        z.writestr("xl/worksheets/sheet2.xml", sheet([("A1", "i", "title"), ("A3", "i", "k"), ("A4", "n", 7)]))
    (tmp_path / "book.xlsx").write_bytes(data.getvalue())
    engine = Engine(folder=str(tmp_path))
    rows = "{|@row, name, unit_price, n| (1, 'abc', '2.5', '1'), (2, 'abc', {}, {}), (3, 'abc', {}, {}), (4, 'abc', '3', '2')}"
    assert engine.eval("//{./book.xlsx}") == engine.eval(rows)
    engine.bind("book", data.getvalue())
    assert engine.eval("//encoding.xlsx.decodeToRelation((sheet: 1, headRow: 2))(book)") == engine.eval("{|@row, k| (3, '7')}")


def test_archives_and_json(capsys, monkeypatch):
    from setweave.__main__ import main

    engine = Engine()
    for kind in ("zip", "tar"):
        data = io.BytesIO(engine.eval(f"//archive.{kind}.{kind}({{'a': {{'b.txt': 'text'}}, 'c': <<1>>, 'd': {{}}}})"))
        if kind == "zip":
            with zipfile.ZipFile(data) as z:
                held = {n: z.read(n) for n in z.namelist()}
        else:
            with tarfile.open(fileobj=data) as t:
                held = {m.name: t.extractfile(m).read() for m in t.getmembers()}
        assert held == {"a/b.txt": b"text", "c": b"\x01", "d": b""}
    monkeypatch.setattr("sys.stdin", io.TextIOWrapper(io.BytesIO(b'{"a": [1, "x"]}')))
    main(["json"])
    assert capsys.readouterr().out == "{'a': (a: [1, (s: 'x')])}\n"


def test_a_folder_as_the_root(spark, tmp_path):
    from setweave.streaming import observe

    at, seen = tmp_path / "watched", []
    (at / "d").mkdir(parents=True)
    (at / "a").write_text("1")
    reactor = observe.Reactor()
    reactor.observe("$", seen.append)
    for name, text in (("d/b", "2"), ("a2", "3")):
        (at / name).write_text(text)
        observe.sync(reactor, spark, str(at), str(tmp_path / "state")).awaitTermination()
    want = [Engine().eval(x) for x in ("{}", "{'a': <<'1'>>, 'd': {'b': <<'2'>>}}", "{'a': <<'1'>>, 'a2': <<'3'>>, 'd': {'b': <<'2'>>}}")]
    assert seen == want


def test_server():
    """Updates by HTTP, and a WebSocket whose observations follow them."""
    from setweave.streaming import server as S
    from setweave.streaming.observe import Reactor

    server = S.Server(Reactor())
    threading.Thread(target=server.serve_forever, daemon=True).start()
    post = lambda code: Engine().eval(f"//net.http.post((), 'http://127.0.0.1:{server.server_port}/update', {show(code)})")
    link = socket.create_connection(("127.0.0.1", server.server_port), timeout=20)
    link.sendall(b"GET /observe HTTP/1.1\r\nHost: x\r\nUpgrade: websocket\r\nConnection: Upgrade\r\nSec-WebSocket-Key: dGhlIHNhbXBsZSBub25jZQ==\r\n\r\n")
    back = link.makefile("rb")
    head = b"".join(iter(back.readline, b"\r\n"))
    assert b"101" in head and b"s3pPLMBiTxaQ9kYGzzhZRbK+xOo=" in head

    def send(text, kind=1):
        data = text.encode()
        link.sendall(bytes([0x80 | kind, 0x80 | len(data)]) + b"mask" + bytes(c ^ b"mask"[i % 4] for i, c in enumerate(data)))

    def heard():
        kind, size = back.read(2)
        return kind & 15, back.read(size).decode(errors="replace")

    send("$ count")
    assert heard() == (1, "0")
    assert post("{1, 2, 3}")["status_code"] == 200.0 and heard() == (1, "3")
    send("$ sum .")
    assert heard() == (1, "6")
    assert post("$ | {4}")["body"] == b'{"{||}": [1, 2, 3, 4]}' and heard() == (1, "10")
    send("", 9)
    assert heard() == (10, "")
    assert post("$ +")["status_code"] == 400.0 and post("{{1}}")["status_code"] == 200.0
    kind, error = heard()
    assert kind == 1 and "error" in error and heard()[0] == 8
    assert Engine().eval(f"//net.http.get((), 'http://127.0.0.1:{server.server_port}/other').status_code") == 404.0
    link.close()
    server.shutdown()


def test_protobuf():
    """A descriptor and a message written part by part."""

    def number(n):
        n &= 2**64 - 1
        return bytes([n]) if n < 128 else bytes([n & 127 | 128]) + number(n >> 7)

    def part(n, x):
        return number(n << 3) + number(x) if isinstance(x, int) else number(n << 3 | 2) + number(len(x)) + x

    def held(name, at, kind, label=1, of=b""):
        return part(2, part(1, name) + part(3, at) + part(4, label) + part(5, kind) + (part(6, of) if of else b""))

    entry = part(1, b"TagsEntry") + held(b"key", 1, 9) + held(b"value", 2, 5) + part(7, part(7, 1))
    inner = part(1, b"Inner") + held(b"x", 1, 17)
    kinds = part(1, b"Kind") + part(2, part(1, b"ZERO") + part(2, 0)) + part(2, part(1, b"ONE") + part(2, 1))
    fields = [(b"id", 1, 5), (b"name", 2, 9), (b"ratio", 3, 1), (b"on", 4, 8), (b"nums", 5, 5, 3), (b"kind", 6, 14, 1, b".p.Kind"), (b"one", 7, 11, 1, b".p.M.Inner"), (b"many", 8, 11, 3, b".p.M.Inner"), (b"tags", 9, 11, 3, b".p.M.TagsEntry"), (b"raw", 10, 12)]
    message = part(1, b"M") + b"".join(held(*f) for f in fields) + part(3, entry) + part(3, inner)
    files = part(1, part(1, b"m.proto") + part(2, b"p") + part(4, message) + part(5, kinds))
    data = part(1, -5) + part(2, "né".encode()) + number(3 << 3 | 1) + struct.pack("<d", 0.5) + part(4, 1) + part(5, number(1) + number(300)) + part(5, 7) + part(6, 1)
    data += part(7, part(1, 3)) + part(8, part(1, 4)) + part(8, b"") + part(9, part(1, b"k") + part(2, 9)) + part(9, part(1, b"z")) + part(10, b"ab") + part(99, 1)
    engine = Engine(d=files, m=data)
    got = engine.eval("let p = //encoding.proto; p.decode(p.descriptor(d))('M')(m)")
    want = "(id: -5, name: 'né', ratio: 0.5, on: true, nums: [1, 300, 7], kind: 'ONE', one: (x: -2), many: [(x: 2), ()], tags: {'k': 9, 'z': 0}, raw: <<'ab'>>)"
    assert got == engine.eval(want)
    for code in ("//encoding.proto.decode(//encoding.proto.descriptor(d))('N')(m)", "//encoding.proto.decode(//encoding.proto.descriptor(d))('M')(<<8>>)"):
        with pytest.raises(EvalError):
            engine.eval(code)


def test_bundles(tmp_path, capsys):
    from setweave.__main__ import main
    from setweave.lang import bundle

    (tmp_path / "lib").mkdir()
    (tmp_path / "main.sw").write_text("//{./lib/add}(//{/data.json}('n'), 1)")
    (tmp_path / "lib" / "add.sw").write_text("\\a \\b a + b")
    (tmp_path / "data.json").write_text('{"n": 41}')
    main(["bundle", str(tmp_path / "main.sw"), str(tmp_path / "out.zip")])
    for name in ("main.sw", "lib/add.sw", "data.json"):
        (tmp_path / name).unlink()
    main(["run", str(tmp_path / "out.zip")])
    assert capsys.readouterr().out == "42\n"
    (tmp_path / "far.sw").write_text("//{../elsewhere}")
    with pytest.raises(EvalError):
        bundle.write(str(tmp_path / "far.sw"), str(tmp_path / "far.zip"))


def test_modules(tmp_path, capsys):
    from setweave.__main__ import main

    (tmp_path / "mods" / "example.org" / "lib").mkdir(parents=True)
    (tmp_path / "mods" / "example.org" / "lib" / "inc.sw").write_text("let by = //{./by}; \\x x + by")
    (tmp_path / "mods" / "example.org" / "lib" / "by.sw").write_text("10")
    (tmp_path / "outside.sw").write_text("1")
    engine = Engine(folder=str(tmp_path), modules=(str(tmp_path / "mods"),))
    assert engine.eval("//{example.org/lib/inc}(5)") == 15.0 and engine.eval("//{outside}") == 1.0
    with pytest.raises(EvalError):
        engine.eval("//{example.org/none}")
    main(["eval", f"--modules={tmp_path / 'mods'}", "//{example.org/lib/inc}(1)"])
    assert capsys.readouterr().out == "11\n"


def test_trees_of_files(tmp_path):
    """What each entry says of what exists; nothing is written if anything is wrong."""
    at, engine = str(tmp_path / "t"), Engine()
    write = lambda code: formats.write_dir(engine.eval(code), at)
    seen = lambda: {os.path.relpath(os.path.join(top, f), at): open(os.path.join(top, f)).read() for top, _, names in os.walk(at) for f in names}
    write("{'a': 'one', 'd': {'x': '1', 'y': '2'}, 'e': {'k': 'v'}}")
    write("{'a': (ifExists: 'replace', file: 'two'), 'd': (ifExists: 'merge', dir: {'z': '3'}), 'e': (ifExists: 'replace', dir: {'n': 'w'})}")
    assert seen() == {"a": "two", "d/x": "1", "d/y": "2", "d/z": "3", "e/n": "w"}
    write("{'a': (ifExists: 'ignore', file: 'three'), 'd': (ifExists: 'remove'), 'new': (ifExists: 'fail', file: 'f'), 'gone': (ifExists: 'remove')}")
    assert seen() == {"a": "two", "e/n": "w", "new": "f"}
    for code in ("{'b': 'b', 'new': (ifExists: 'fail', file: 'g')}", "{'b': 'b', 'a': (ifExists: 'merge', file: 'g')}", "{'b': 'b', 'a': (ifExists: 'replace')}", "{'b': 'b', 'c': (ifExists: 'x', file: '')}", "{'b': 'b', '..': ''}", "{'b': 1}"):
        with pytest.raises((ValueError, FileExistsError)):
            write(code)
    assert seen() == {"a": "two", "e/n": "w", "new": "f"}


def test_patterns_over_relations(spark):
    data = [("a", 1.0), ("a", 2.0), ("b", 5.0), ("c", 7.0)]
    engine = Engine(spark)
    engine.bind("R", Rel.of(spark, "k string, x double", data))
    local = "{|k,x| ('a',1),('a',2),('b',5),('c',7)}"
    text = " filter . {(k: 'a', x: n): (kind: 'first', n: n), (k: 'b', ...): (kind: 'second', n: 0)}"
    want = Engine().eval(local + text)
    assert rows(engine.eval("R" + text)) == sorted((t["kind"], t["n"]) for t in want) == [("first", 1.0), ("first", 2.0), ("second", 0.0)]
    text = " => (y: cond .x {1: 'one', 2: 'two', n: $'${n}'})"
    assert rows(engine.eval("R" + text)) == sorted((t["y"],) for t in Engine().eval(local + text))
    assert rows(engine.eval("R filter . {(x: 5, y?: z:3, ...): z}")) == [(3.0,)]


def test_nested_merges_over_relations(spark):
    engine = Engine(spark)
    engine.bind("R", Rel.of(spark, "k string, t struct<b: double, u: struct<c: double>>", [("a", (1.0, (2.0,)))]))
    made = engine.eval("R => . +> (t+>: (b: 7, u+>: (d: .k)), k++: '!')").df.first()
    assert made.k == "a!" and made.t.b == 7.0 and made.t.u.asDict() == {"c": 2.0, "d": "a"}
