"""Symbol search by path and depth, and references through the index of mentions."""

from pyspark.sql import functions as F

from tesserine.operators import symbols

CODE = '''class Cart:
    def add(self, item):
        def check(x):
            return x
        return check(item)

    def total(self):
        return self.add(0)


def total(cart):
    cart.add(1)
    return cart.total()


total(Cart())
'''
JS = "class Cart {\nfunction pay(cart) {\n  return cart.total\n}\n"


def test_find_by_name_path_and_depth(spark, files):
    f = files({"a/cart.py": CODE, "b/cart.py": CODE, "a/pay.js": JS})
    got = lambda *a, **k: {(r.file_path, r.name_path, r.level) for r in symbols.find_symbol(f, *a, **k).collect()}
    assert got("^total$", "a/") == {("a/cart.py", "Cart/total", 0), ("a/cart.py", "total", 0)}
    assert got("^Cart/total$", "a/") == {("a/cart.py", "Cart/total", 0)}
    assert got("^Cart$", "a/", depth=1) == {("a/cart.py", "Cart", 0), ("a/cart.py", "Cart/add", 1), ("a/cart.py", "Cart/total", 1), ("a/pay.js", "Cart", 0)}
    assert ("a/cart.py", "Cart/add/check", 2) in got("^Cart$", "a/", depth=2) and not got("^nothing$")
    body = symbols.find_symbol(f, "^Cart/add/check$", "b/", with_body=True).first()
    assert (body.body, body.found_line, body.line_end) == ("        def check(x):\n            return x", 3, 4)


def references(index, table, **k):
    return {(r.project, r.file_path, r.line_number, r.name, r.kind) for r in symbols.symbol_references(index, table, **k).collect()}


def test_references_with_kinds_and_paths(spark, files):
    f = files({"a/cart.py": CODE, "a/pay.js": JS}).unionByName(files({"a/cart.py": "add = total\n", "é.py": ""}, project="q"))
    table = symbols.symbol_table(f)
    want = {("p", "a/cart.py", 5, "check", "function"), ("p", "a/cart.py", 8, "add", "function"), ("p", "a/cart.py", 12, "add", "function"), ("p", "a/cart.py", 16, "total", "file"),
            ("p", "a/cart.py", 16, "Cart", "file"), ("p", "a/pay.js", 3, "total", "file")}
    for index in (symbols.scratch_index(f), symbols.scratch_index(f, table)):
        assert references(index, table) == want  # the other project has no such symbols
        assert references(index, table, include_kinds=["file"]) == {x for x in want if x[4] == "file"}
        assert references(index, table, exclude_kinds=["file"]) == {x for x in want if x[4] != "file"}
        assert references(index, table, name="add") == {x for x in want if x[3] == "add"}
        assert references(index, table, path_prefix="a/pay") == {("p", "a/cart.py", 16, "Cart", "file")}
    gaps = index.where("token = 'add'").select(F.aggregate("gaps", F.lit(0), lambda a, g: a + g).alias("last")).first()
    assert gaps.last == 12


def test_lookups_do_not_shuffle_the_index(spark, files):
    f = files({f"d/m{i}.py": CODE for i in range(20)})
    table = symbols.symbol_table(f)
    index = symbols.scratch_index(f, table)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        hit = symbols.symbol_references(index, table)
        plan = hit._jdf.queryExecution().executedPlan().toString()
        assert "Bucketed: true" in plan
        assert hit.count() == 20 * 5
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_a_full_filter_changes_nothing(spark, files, monkeypatch):
    monkeypatch.setattr(symbols, "FILTER", 5)
    f = files({"a/cart.py": CODE})
    table = symbols.symbol_table(f)
    cells = symbols.name_filter(table)
    assert cells.shape == (1,) and cells[0]
