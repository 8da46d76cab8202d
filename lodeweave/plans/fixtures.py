"""Small rows that the driver's tables lack (code that detectors hit, patches with added lines, long histories), added to whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_AUTH = "import flask\n\n@app.route('/open')\ndef open_page():\n    return 1\n\n\n@app.get('/kept')\n@login_required\ndef kept():\n    return 2\n\n\n@cached\ndef plain():\n    return 3\n"
_BAD = 'password = "hunter22x"\nx = eval(data)\ncur.execute("SELECT * FROM t WHERE a = " + b)\nimport random\nrandom.choice(a)\nreturn redirect(request.args["next"])\n'
_TWIN = "def load_price_table(path):\n    price_rows = []\n" + "".join(f"    price_rows.append(read_price(path, {i}))\n" for i in range(21)) + "    return price_rows"
#: name -> (schema, rows)
TABLES: dict[str, tuple[str, list[tuple]]] = {
    "code": ("chunk_id string, language string, raw_code string", [
        ("fx-py", "python", _BAD), ("fx-safe", "python", "z = eval(w)  # nosec\n# eval(x)\nsubprocess.run([a])\nyaml.load(f, Loader=yaml.SafeLoader)\nsecrets.choice(a)\n"),
        ("fx-py2", "python", "exec(code)\npickle.loads(b)\nyaml.load(f)\nos.system(c)\nsubprocess.run(a, shell=True)\nreturn HttpResponseRedirect(request.GET['n'])\nrandom.randint(1, 6)\n"),
        ("fx-js", "javascript", "el.innerHTML = x;\nif (el.innerHTML == y) {}\ndocument.write(z);\nnew Function(a);\nconst r = Math.random();\nres.redirect(req.query.next);\n"),
        ("fx-rb", "ruby", "instance_eval(x)\nMarshal.load(y)\nrand(10)\nredirect_to params[:next]\nexecute(\"DELETE FROM t WHERE id = #{id}\")\n"), ("fx-java", "java", "Runtime.getRuntime().exec(cmd);\nnew Random();\nClass.forName(n);\n"),
        ("fx-go", "go", "exec.Command(name)\n"), ("fx-auth", "python", _AUTH), ("fx-null", "python", None),
    ]),
    "patches": ("pr_file_id string, patch string", [
        ("fx-1", "@@ -1,1 +1,3 @@\n x\n+y\n+z"), ("fx-2", "@@ -1 +2 @@\n+a\n@@ -9 +12 @@\n+b"), ("fx-3", "@@ -1,2 +1,2 @@\n x\n-y"), ("fx-4", "@@ -0,0 +1,6 @@\n+p\n+x\n c\n+d\n+e\n"),
    ]),
    "pr_files": ("pr_id string, pr_file_id string, filename string, content string", [
        ("fx-pr", "fx-4", "apps/a/x.py", _BAD), ("fx-pr", "fx-5", "vendor/x.py", _BAD), ("fx-pr", "fx-6", "apps/a/routes.py", _AUTH), ("fx-pr", "fx-7", "apps/a/y.js", "el.innerHTML = x;\n"), ("fx-pr", "fx-8", "a/z.py", None),
    ]),
    "scores": ("repo_id string, commit_id string, file_path string, language string, total_score double", [("fx", f"fx-{i}", "f.py", "python", s) for i, s in enumerate([1.0, 1.1, 1.2, 1.3, 1.4, 1.5, 1.6, 9.0])]),
    "commits": ("commit_id string, sha string, day int", [(f"fx-{i}", f"fxsha{i}", i) for i in range(8)]),
    "stamps": ("id int, stamp string", [(1, "2024-05-01T10:20:30Z"), (2, "2024-05-01T10:20:30+02:00"), (3, "not a time"), (4, None), (5, "2024-13-01T00:00:00Z")]),
    "twins": ("chunk_id string, repo_id string, commit_id string, file_path string, chunk_name string, chunk_type string, language string, start_line int, end_line int, complexity_score double, raw_code string, embedding string", [
        ("fx-q220", "fx", "fx-0", "apps/orders/prices.py", "load_price_table", "function", "python", 1, 24, 5.0, _TWIN, "1,0,0,0"), ("fx-t1", "fx", "fx-0", "apps/stock/tables.py", "load_price_table", "function", "python", 5, 28, 5.0, _TWIN, "1,0.01,0,0"),
        ("fx-t2", "fx", "fx-0", "apps/orders/views.py", "load_price_table", "function", "python", 1, 24, 5.0, _TWIN, "1,0.02,0,0"), ("fx-t3", "fx", "fx-0", "apps/stock/maps.py", "draw_map", "function", "python", 1, 24, 5.0, _TWIN, "1,0,0.01,0"),
        ("fx-whole", "fx", "fx-0", "apps/whole.py", "whole", "module", "python", 1, 6, 1.0, "import os\n\n\ndef f():\n    return os.name  \n", "0,0,0,1"), ("fx-cut", "fx", "fx-0", "apps/whole.py", "f", "function", "python", 4, 5, 1.0, None, "0,0,1,0"),
    ]),
    "urls": ("id int, url string", [(1, "https://github.com/a/b"), (2, "http://github.com/a/b"), (3, "https://example.org/a"), (4, "https://x@github.com/a"), (5, None), (6, "git@github.com:a/b")]),
}


def frame(spark: SparkSession, name: str) -> DataFrame:
    schema, rows = TABLES[name]
    return spark.createDataFrame(rows, schema)


def sql(name: str) -> str:
    """The same rows as a SELECT."""
    schema, rows = TABLES[name]
    quote = lambda v: "NULL" if v is None else str(v) if not isinstance(v, str) else "'" + v.replace("'", "''") + "'"
    kinds = {"string": "VARCHAR", "int": "INT", "double": "DOUBLE"}
    fields = [f.strip().split() for f in schema.split(",")]
    cast = ", ".join(f"{n}::{kinds[t]} AS {n}" for n, t in fields)
    values = ", ".join("(" + ", ".join(map(quote, r)) + ")" for r in rows)
    return f"(SELECT {cast} FROM (VALUES {values}) AS fx({', '.join(n for n, _ in fields)}))"
