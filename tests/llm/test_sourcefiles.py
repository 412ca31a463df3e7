import random

from millrace.llm import sourcefiles as S

rng = random.Random(1)
HAND = "\n".join(f"def f{rng.randrange(999)}(a, b={rng.randrange(99)}):\n    x = load(a)\n    if x > {rng.randrange(99)}:\n        return fold('{rng.randrange(99)}', b)\n    log.info('done %s', x)\n    return merge(x, {rng.randrange(9)})\n" for _ in range(12))
FILES = {
    "R/a.py": HAND, "R/b.py": "# writes the DO NOT EDIT banner into the files it builds\n" + HAND, "R/c.py": "# reads reports generated by the matcher\n" + HAND, "R/vendors/d.py": HAND, "R/vendor_x/lib/e.py": HAND, "R/README.md": "# Written by hand\n\nDo not edit.\n",
    "R/conf.json": '{\n  "name": "x",\n  "note": "all that was said of it",\n  "limit": 3,\n  "list": ["a", "b"]\n}', "R/mid.py": HAND + "\n# Code generated by protoc. DO NOT EDIT.\nTEMPLATE = 1\n" + HAND, "R/w.py": "# replaces the auto-generated index of last year\n" + HAND, "R/served.js": "// minified assets are served from elsewhere\nlet a = 1;", "R/own.py": "# (c) 2024 R maintainers, internal use\n" + HAND, "R/merge_pb.py": HAND, "R/empty.py": "",
    "R/g1.py": "# This file was generated automatically; manual changes will be lost.\n" + HAND, "R/g2.ts": "\n".join(f"export interface a{i} {{ f{i}: string }}" for i in range(1, 30)), "R/g3.js": "/* Do not change this file: it is produced from x.yaml by the build step */\nlet a = 1;",
    "R/late.go": "// licence text, line by line.\n" * 60 + "// Code generated by protoc. DO NOT EDIT.\n\npackage x\n" + HAND, "R/php.php": "<?php\n/* " + "terms " * 300 + "*/\n// AUTO-GENERATED FILE - regenerate with `make x`\n" + HAND,
    "R/m1.js": "var a=1;function b(c){return c+a}" * 200, "R/x.min.css": ".a{b:c}", "R/v1.js": "/* tinydelta v6.1.2 | (c) 2015 the Parsnip maintainers | released under the Free Reuse licence */\n" + HAND, "R/node_modules/p/i.js": HAND, "R/third_party/p/1/x.py": HAND, "R/lib/foo-1.2.3-x.js": HAND,
    "R/d1.py": "DATA = (\n" + "\n".join(f"  '{'abcdEFGH1234' * 9}'" for _ in range(30)) + ")", "R/d2.js": "const T = [\n" + "\n".join("    " + ", ".join(f"0x{rng.randrange(256):02x}" for _ in range(12)) + "," for _ in range(40)) + "];", "R/d3.json": str([[i, rng.random() * 99] for i in range(300)]).replace(" ", ""),
    "R/d4.sql": "INSERT INTO t VALUES\n" + ",\n".join(f"({i},'{rng.getrandbits(48):012x}',{rng.randrange(10**6)},'open',0.{rng.randrange(999)})" for i in range(60)) + ";", "R/i.sql": "\n".join(f"SELECT a, sum(b) AS s_{i * 7 % 13} FROM t{i} JOIN u ON t.k = u.k WHERE c > {i * 37 % 11};" for i in range(20)),
}
WANT = {"late": "generated", "php": "generated", "g1": "generated", "g2": "generated", "g3": "generated", "m1": "minified", "x.min": "generated", "v1": "vendored", "node_modules/p/i": "vendored", "third_party/p/1/x": "vendored", "lib/foo-1.2.3-x": "vendored", "d1": "data", "d2": "data", "d3": "data", "d4": "data"}


def frames(spark, files):
    h = spark.createDataFrame([(i, "R", k[2:] if i % 2 else k, t[:700], 0, 9) for i, (k, t) in enumerate(files.items())] + [(99, None, "R/only.py", None, 0, 9)], "hit_id int, repo string, path string, text string, chunk int, chars int")
    c = spark.createDataFrame([(k, j, t[a:a + 1200]) for k, t in files.items() for j, a in enumerate(range(0, len(t), 1200))] + [("R/not_hit.py", 0, "x")] * 2, "path string, chunk int, text string")
    return h, c


def test_kinds(spark):
    got = {r.path_key: r.kind for r in S.judged_files(*frames(spark, FILES)).collect()}
    assert got == {**{k: WANT.get(k[2:].rsplit(".", 1)[0]) for k in FILES}, "R/only.py": None}


def test_empty(spark):
    h, c = frames(spark, FILES)
    assert S.judged_files(h.limit(0), c).count() == 0 and S.judged_files(h, c.limit(0)).count() == len(FILES) + 1
    S.measure("x" * 500_000, "js"), S.measure("/*" * 50_000, "js"), S.measure("'" * 10_001, "py")


def test_repeats_and_cut_copies_change_nothing(spark):
    """A piece logged often, or cut short, weighs no more than once."""
    short = "let a = load(4);\nfold(a);\n"
    data = "const T = [\n" + "\n".join("    " + ", ".join(f"0x{i * 7 % 256:02x}" for i in range(12)) + "," for _ in range(9)) + "\n"
    few = "x = [\n" + "\n".join(f"  {i}, {i * 3}," for i in range(3)) + "\n"
    h, c = frames(spark, {"R/a.js": short, "R/b.js": data + HAND * 2, "R/c.py": few})
    one = {r.path_key: r for r in S.judged_files(h, c).collect()}
    more = h
    for n in (1, 2, 5, 30, 90):
        more = more.unionByName(h.withColumn("text", h.text.substr(1, n)))
    for _ in range(3):
        more = more.unionByName(more)
    assert {r.path_key: r for r in S.judged_files(more, c.unionByName(c)).collect()} == one


def test_canonical_layout_holds_the_same_tokens():
    text = "function a(b){if(b>1){return 'x;{'}else{c( b ,2 )}}\nlet d=1;e = \"f\"  // g\n"
    tokens = lambda s: [m.group() for m in S.TOKEN.finditer(s) if m.lastgroup not in "cn"]
    out = S.emit([(m.lastgroup, m.group()) for m in S.TOKEN.finditer(text) if m.lastgroup != "c"])
    assert tokens("\n".join(out)) == tokens(text)
    assert out[:3] == ["function a(b){", "  if(b>1){", "    return'x;{'"] and S.emit([]) == []
    assert S.measure("var a=1;" * 100, "js")[S.SUMS.index("canonical")] == 100


def test_uniform_layout():
    m = dict(zip((*S.SUMS, *S.FLAGS), S.measure("\n".join(f"  field_{i}: Text({i});" for i in range(20)), "ts")))
    assert m["serial_lines"] == 20
    m = dict(zip((*S.SUMS, *S.FLAGS), S.measure("\n".join(f"{' ' * (i * 7 % 5)}field_{i}: Text({i});" for i in range(20)), "ts")))
    assert m["serial_lines"] == 0  # numbers alone are not enough, the layout must agree


def test_comments_lead_a_file_as_long_as_no_code_comes_before(spark):
    long = "/* " + "terms of use, line by line\n" * 80 + "*/\n"
    h, c = frames(spark, {"R/a.js": long + "// This file was generated automatically\nlet a = 1;", "R/b.js": "let a = 1;\n" + long + "// This file was generated automatically\nlet b = 2;"})
    assert {r.path_key: r.kind for r in S.judged_files(h, c).collect()} == {"R/a.js": "generated", "R/b.js": None, "R/only.py": None}
