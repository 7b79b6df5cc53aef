import json
import os

import pytest

from windrow import Config, Detector
from windrow.__main__ import config_from
from windrow.functions.tokens import normalise
from windrow.sources import files as S

CODE = '''import os


class Shop:
    """Sells things."""

    def price(self, item, count):
        # a comment
        total = item.cost * count
        if total > 100 and count > 3:
            total = total - total / 10
        return total

    def label(self, item):
        return "%s for %d" % (item.name, self.price(item, 1))
'''
RENAMED = CODE.replace("price", "amount").replace("total", "result").replace("item", "thing").replace("a comment", "other words").replace("Shop", "Store")


@pytest.fixture
def tree(tmp_path):
    for name, text in {"one/a.py": CODE, "two/a.py": RENAMED, "two/__init__.py": "x = 1\n", "two/.hidden.py": "y = 2\n", "three/b.txt": "hello"}.items():
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_text(text)
    return tmp_path


def test_listing(tree, caplog):
    names, bare = S.list_files([str(tree), str(tree / "none")], ["py"])
    assert [os.path.relpath(n, tree) for n in names] == ["one/a.py", "two/.hidden.py", "two/__init__.py", "two/a.py"]
    assert bare == [str(tree / "none")] and "No files found" in caplog.text
    assert S.list_files([str(tree)], [".txt"])[0] == [str(tree / "three/b.txt")]
    assert len(S.list_files([str(tree), str(tree / "one")], ["*"])[0]) == 5


def test_renamed_copy_is_found(spark, tree):
    d = Detector(spark, Config(test_dirs=[str(tree)], extensions=["py"], noise_t=10, guarantee_t=12, autoopen=False, out_file=str(tree))).run()
    got = d.copied_code_list()
    assert len(got) == 1 and got[0][0] == got[0][1] == 1.0
    assert os.path.basename(got[0][2]) == "a.py" and '<span class="hit">' in got[0][4]
    page = d.report("return")
    assert "100.00%" in page and "<svg" in page
    assert d.report() == str(tree / "report.html") and os.path.exists(tree / "report.html")
    with pytest.raises(ValueError):
        d.report("show")
    dense = {(r.test, r.ref): r.test_sim for r in d.dense_matrix().collect()}
    assert len(dense) == 16 and sum(v == -1 for v in dense.values()) == 4


def test_raw_text_differs_and_boilerplate_removes(spark, tree):
    raw = Detector(spark, Config(test_dirs=[str(tree)], extensions=["py"], noise_t=20, guarantee_t=20, disable_filtering=True, display_t=0.9))
    assert raw.matches.count() == 0 and raw.documents.where("filtered <> text").count() == 0
    cleared = Detector(spark, Config(test_dirs=[str(tree / "one"), str(tree / "two")], boilerplate_dirs=[str(tree / "one")], noise_t=10, guarantee_t=10))
    assert cleared.pairs.count() == 0


def test_added_files_and_roles(spark, tree):
    d = Detector(spark, Config(test_dirs=[str(tree / "one")], ref_dirs=[str(tree / "three")], noise_t=10, guarantee_t=10))
    assert d.pairs.count() == 0
    d.add_file(str(tree / "two/a.py"), "ref")
    assert [(os.path.basename(r.test), r.test_sim) for r in d.pairs.collect()] == [("a.py", 1.0)]
    with pytest.raises(ValueError):
        d.add_file("x", "other")


def test_nothing_to_compare(spark, tree, caplog):
    d = Detector(spark, Config(test_dirs=[str(tree / "none")])).run()
    assert d.copied_code_list() == [] and "No documents" in caplog.text


def test_undecodable_and_detected_files(spark, tmp_path):
    (tmp_path / "bad.txt").write_bytes(b"\xff\xfe\xfa\xc3(")
    (tmp_path / "wide.txt").write_bytes("hällo\r\nworld".encode("utf-16"))
    files = S.file_table(spark, *[S.list_files([str(tmp_path)], ["*"])[0]] * 2, [])
    good, bad = S.read_files(files, "utf-8")
    assert good.count() == 0 and bad.count() == 2
    assert "hällo\nworld" in {r.text for r in S.read_files(files, "DETECT")[0].collect()}
    assert S.decode("hällo".encode("latin-1"), "DETECT") == ("hällo", None)


def test_unknown_extensions_are_named(spark, caplog):
    docs = S.from_texts(spark, [("a.py", CODE), ("b.nosuchkind", "plain words")])
    Detector(spark, Config(noise_t=10, guarantee_t=10, silent=True), documents=docs).run()
    assert "No tokenizer for b.nosuchkind" in caplog.text and "a.py" not in caplog.text


def test_directory_source(spark, tree):
    from windrow.sources.directory import register

    register(spark)
    rows = spark.read.format("windrow_files").option("extensions", "py").option("files_per_task", "2").load(str(tree)).collect()
    assert len(rows) == 4 and all(r.problem is None for r in rows)


def test_in_memory_and_table_documents(spark):
    docs = S.from_texts(spark, [("a.py", CODE), ("b.py", RENAMED)])
    assert Detector(spark, Config(noise_t=10, guarantee_t=10), documents=docs).pairs.count() == 2
    table = spark.createDataFrame([(1, "x", "y")], "id int, text string, lang string")
    r = S.from_table(table, "id", name_col="lang").first()
    assert (r.path, r.name, r.leaf, r.is_test, r.is_boilerplate) == ("1", "y", None, True, False)


def test_tokens():
    assert normalise("def f(a):\n    return a + 'x'\n", "a.py")[0] == "defF(V):returnV+\"S\""
    assert normalise("#include <stdio.h>\n", "a.c")[0].startswith("PP")
    assert normalise("class A: pass\n", "a.py")[0] == "classO:pass"
    assert normalise("some text", "a.unknown") == ("some text", [], None)
    assert normalise("some text", "a.txt")[0] == "some text" and normalise("some text", "a.txt", compat=True)[0] == ""
    assert normalise("# x", "a.py", language="java")[0].startswith("#")
    text, offsets, _ = normalise("x = 1  # note\nyy = 2\n", "a.py")
    assert text == "V=1V=2" and offsets[0] == (0, 0) and [p for p, _ in offsets[1:]] == sorted(p for p, _ in offsets[1:])


@pytest.mark.parametrize("name, code, expected", [
    ("a.c", "/* sum */\nint add(int a, int b) {\n  return a + b; // both\n}\n", "intF(intV,intV){returnV+V;}"),
    ("a.java", "class Box {\n  int get(int n) { return n + 1; }\n}\n", "classO{intF(intV){returnV+1;}}"),
    ("a.php", "<?php\nfunction twice($n) {\n  return $n * 2; # double\n}\n?>\n", "PfunctionF(V){returnV*2;}P\n"),  # what is outside of PHP stays
])
def test_tokens_of_other_languages(name, code, expected):
    text, offsets, _ = normalise(code, name)
    assert text == expected
    for mark in "FO":  # a renamed token's own row, before that of white space after it, leads to its start in the raw text
        for p in (i for i, c in enumerate(text) if c == mark):
            raw = p + next(removed for at, removed in offsets if at == p)
            assert code[raw:].startswith({"F": {"a.c": "add", "a.java": "get", "a.php": "twice"}[name], "O": "Box"}[mark])


def test_config(tmp_path):
    c = Config.from_dict({"test_directories": ["t"], "noise_threshold": 10.0, "guarantee_threshold": 15, "disable_autoopen": True, "out_file": str(tmp_path), "css": ["a.css"]})
    assert (c.noise_t, c.window_size, c.autoopen, c.ref_dirs, c.out_file, c.css_files) == (10, 6, False, ["t"], str(tmp_path / "report.html"), ["a.css"])
    assert Config.from_dict(c.to_dict()) == c
    assert Config(out_file=str(tmp_path / "x")).out_file == str(tmp_path / "x.html")
    for bad in ({"guarantee_t": 5}, {"display_t": 2}, {"out_file": str(tmp_path / "no/x")}, {"noise_t": 0}):
        with pytest.raises(ValueError):
            Config(**bad)
    for bad in ({"test_dirs": "x"}, {"truncate": 1}, {"force_language": 3}, {"noise_t": 2.5}, {"encoding": None}):
        with pytest.raises(TypeError):
            Config(**bad)


def test_command_line(tmp_path):
    c = config_from(["-t", "a", "b", "-n", "10", "-g", "12", "-d", "0.5", "-s", "-l", "-f", "-a", "-T", "-o", "java", "-e", "java", "-O", str(tmp_path)])
    assert (c.test_dirs, c.noise_t, c.display_t, c.same_name_only, c.ignore_leaf, c.disable_filtering, c.autoopen, c.truncate, c.force_language) == (["a", "b"], 10, 0.5, True, True, True, False, True, "java")
    (tmp_path / "c.json").write_text(json.dumps({"test_directories": ["z"]}))
    assert config_from(["-c", str(tmp_path / "c.json"), "-n", "99"]).test_dirs == ["z"]
    with pytest.raises(SystemExit):
        config_from([])
