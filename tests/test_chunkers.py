"""Chunks of every language against cases cut by hand."""

import pytest

from lodeweave.operators import chunker, scanners

CASES = {
    "javascript": ("// function no() {\nclass A extends B {\n  run(x) {\n    if (x && y) { return '}'; }\n  }\n}\nasync function go(a = {}) {\n  const f = (b) => {\n    return `}` + b;\n  };\n}\n", [("A", "class", 2, 6), ("run", "function", 3, 5), ("go", "function", 7, 11)], [("run", "method", 3, 5), ("go", "function", 7, 11), ("f", "function", 8, 10)]),
    "typescript": ("export class A<T> {\n  private get<K>(x: K): Map<K, T> {\n    return this.m;\n  }\n}\nconst f = async (a: number): Promise<void> => {\n  for (;;) {}\n};\n", [("A", "class", 1, 5), ("get", "function", 2, 4), ("f", "function", 6, 8)], [("get", "method", 2, 4), ("f", "function", 6, 8)]),
    "java": ("package a;\npublic class A {\n    /* } */\n    public A(int x) {\n        this.x = x;\n    }\n\n    @Override\n    public String name(List<String> a) throws E {\n        if (a == null) { return \"{\"; }\n        return b;\n    }\n}\n", [("A", "class", 2, 13), ("A", "function", 4, 6), ("name", "function", 8, 12)], [("A", "method", 4, 6), ("name", "method", 8, 12)]),
    "go": ("package a\n\ntype T struct {\n\tx int\n}\n\nfunc (t *T) Get(k string) (int, error) {\n\tif k == \"}\" {\n\t\treturn 1, nil\n\t}\n\treturn 0, nil\n}\n\nfunc main() {\n}\n", [("T", "class", 3, 5), ("Get", "function", 7, 12), ("main", "function", 14, 15)], [("Get", "function", 7, 12), ("main", "function", 14, 15)]),
    "ruby": ("class A\n  # def no\n  def self.run(x)\n    if x\n      1\n    end\n    y = 2 if x\n    [1].each do |z|\n      z\n    end\n  end\nend\n\ndef f\n  while a\n    b\n  end\nend\n", [("A", "class", 1, 12), ("self.run", "function", 3, 11), ("f", "function", 14, 18)], [("self.run", "method", 3, 11), ("f", "method", 14, 18)]),
    "rust": ("impl A {\n    fn get<'a>(&'a self) -> char {\n        match x { _ => '}' }\n    }\n}\n", [("A", "class", 1, 5), ("get", "function", 2, 4)], [("get", "function", 2, 4)]),
    "c": ("#include <a.h>\nstruct S {\n  int a;\n};\nstatic int add(int a, int b) {\n  return a + b; /* } */\n}\n", [("S", "class", 2, 4), ("add", "function", 5, 7)], [("add", "function", 5, 7)]),
    "cpp": ("class A {\n  int get() const {\n    return 1;\n  }\n};\n", [("A", "class", 1, 5), ("get", "function", 2, 4)], [("get", "function", 2, 4)]),
    "php": ("<?php\nclass A {\n  public function run($x) {\n    # }\n    return '}';\n  }\n}\n", [("A", "class", 2, 7), ("run", "function", 3, 6)], [("run", "function", 3, 6)]),
}


@pytest.mark.parametrize("language", sorted(CASES))
def test_cases(language):
    text, history, review = CASES[language]
    cut = scanners.scanner(language)
    assert [c[:4] for c in cut(text, "history")] == history
    got = [c[:4] for c in cut(text, "review")]
    assert [c for c in got if c[1] != "class"] == review
    assert cut("", "history") == []
    assert all(1 <= a <= b <= text.count("\n") + 1 for _, _, a, b, _ in cut(text[: len(text) // 2], "review"))  # truncated


def test_complexity():
    assert scanners.complexity("if (a && b) { } else if (c) { } else { }") == 5
    assert [c[4] for c in scanners.scanner("go")("func f() {\n\tif a || b {\n\t}\n}\n", "history")] == [3]


def test_all_languages(spark):
    suffix = {"javascript": "js", "typescript": "ts", "java": "java", "go": "go", "ruby": "rb", "rust": "rs", "c": "c", "cpp": "cpp", "php": "php"}
    df = spark.createDataFrame([(f"x.{suffix[k]}", v[0]) for k, v in CASES.items()] + [("x.css", "a {}"), ("y.go", None)], "p string, t string")
    got = {(r.p, r.chunk_name, r.start_line) for r in chunker.chunk_files(df, "p", "t", "p").collect()}
    assert got == {(f"x.{suffix[k]}", n, a) for k, v in CASES.items() for n, _, a, _ in v[1]}
