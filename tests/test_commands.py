"""Search commands, read or not read."""

import pytest

from sparklore.functions import commands as K


@pytest.mark.parametrize(
    ("command", "found"),
    [
        ("grep -rn 'parseBody' src", ("", ["parseBody"], ["src"], [], [])),
        ("cd app && rg -t py --glob '!x/**' 'fn\\s+run_all' | head -3", ("app", ["run_all"], [], ["!x/**"], ["py"])),
        ("cd a; cd b; git grep -e alpha -- lib", ("a/b", ["alpha"], ["lib"], [], [])),
        ("RUST_LOG=x egrep 'one_a|two_b' .", ("", ["one_a", "two_b"], ["."], [], [])),
        ("grep -F 'name_x' --include=*.rs -A 3 d", ("", ["name_x"], ["d"], ["*.rs"], [])),
        ("rg '\\bhandle\\(' src lib", ("", ["handle"], ["src", "lib"], [], [])),
        ("cat x | grep foo_bar", None),
        ("grep 'a.*b' src", None),
        ("grep \"$(cat p)\" src", None),
        ("grep -f names src", None),
        ("grep -e aaa -e bbb src", None),
        ("grep 'aa1|bb2|cc3|dd4|ee5|ff6|gg7' .", None),
        ("ls -la", None),
        ("grep 'open quote", None),
        ("", None),
    ],
)
def test_search_commands(command, found):
    assert K.search_of(command) == found


def test_searches_as_rows(spark):
    rows = spark.createDataFrame([("grep foo_bar src",), ("ls",), (None,)], "command string")
    assert [(r.command, r.symbols) for r in K.searches(rows).collect()] == [("grep foo_bar src", ["foo_bar"])]
