import pytest

from quarry.functions import globs as G
from quarry.functions import instant as I


@pytest.mark.parametrize("expr,value", [("1+2*3", 7), ("-2^2", 4), ("2^3^2", 512), ("7%-4", 3), ("-7%4", -3), ("0x1F+0b11", 34), ("1e3", 1000), ("1/0", None), ("min(3,1,0)", 1), ("min(3)", None), ("log(8,2)", 3), ("round(2.5)", 2), ("(1", None), ("sqrt(-1)", None)])
def test_calculator(expr, value):
    got = I.evaluate(expr)
    assert got == value if value is None else abs(got - value) < 1e-9


@pytest.mark.parametrize("text,out", [("255 to hex", "0xFF"), ("0b101 to dec", "5"), ("8 to oct", "010"), ("0xA to bin", "0b1010"), ("2.7 to hex", "0x2"), ("x to hex", None)])
def test_bases(text, out):
    assert I.convert_base(text) == out


def test_templates():
    assert I.fill_url("https://x/?q=%s", "a b") == "https://x/?q=a%20b"
    assert I.fill_url("https://x/{0}", "ü") == "https://x/%C3%BC"
    assert I.fill_url("https://x/", "a") == "https://x/a"
    assert I.fill_command("run %s2 %s1", '"a b" c') == "run c a b"


@pytest.mark.parametrize(
    "glob,path,hit",
    [("*.txt", "a/b/x.txt", True), ("*.txt", "a/x.txt/y", False), ("src/*.txt", "src/x.txt", True), ("src/*.txt", "src/a/x.txt", False), ("/src/**/*.cs", "src/a/b/x.cs", True), ("/src/**/*.cs", "src/x.cs", True), ("file?.txt", "file1.txt", True), ("file?.txt", "file12.txt", False), ("[ab].c", "a.c", True), ("{x,y}.c", "y.c", True), ("a/**", "a/b/c", True), ("**/z", "q/w/z", True)],
)
def test_globs(glob, path, hit):
    import re

    assert bool(re.search(G.glob_regex(glob), path)) == hit


@pytest.mark.parametrize("glob", ["a]", "[a", "{a", "a}", "{a,{b}}"])
def test_bad_globs(glob):
    with pytest.raises(ValueError):
        G.glob_regex(glob)
