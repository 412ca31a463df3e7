import __spark_entry__ as entry


def test_registered_for_each_problem():
    names = entry.queries()
    assert {f"p{n}_found" for n in (1, 2, 4, 7, 8)} <= set(names) and "p6_packed" in names
