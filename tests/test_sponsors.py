"""Sponsors of paths against brute force."""

from lexstrata.operators import annotations as notes


def test_people_of_a_bill_stay_together(spark):
    """A row for each path of an annotation, however many sponsors; unknown members, bills and nulls are dropped, repeats counted."""
    marks = [("b1", ["p", "q"]), ("b1", ["p"]), ("b2", ["p", "p"]), ("b3", ["r"]), (None, ["p"]), ("b4", None), ("b5", ["s"])]
    bills = [("b1", "m1", ["m2", "m2", None]), ("b2", "m9", ["m3"]), ("b2", "m1", []), ("b3", "m8", ["m9"]), (None, "m1", []), ("b5", "m2", None)]
    people = [("m1", "One"), ("m2", "Two"), ("m2", "Two again"), ("m3", "Three")]
    annotations = spark.createDataFrame(marks, "bill_id string, paths array<string>")
    sponsors = spark.createDataFrame([(b, s, c if c is None else [(x,) for x in c]) for b, s, c in bills], "bill_id string, sponsor string, cosponsors array<struct<bioguide_id: string>>")
    members = spark.createDataFrame(people, "bioguide_id string, name string")
    want = sorted((p, m, name) for b, paths in marks for p in paths or [] for k, s, c in bills if k and k == b and c is not None for x in [s, *c] for m, name in people if m == x)
    assert sorted(map(tuple, notes.sponsors_for_path(annotations, sponsors, members).collect())) == want
    assert sorted(map(tuple, notes.sponsors_for_path(annotations, sponsors, members, "p").collect())) == [x for x in want if x[0] == "p"]
    rows = notes.with_sponsors(annotations, sponsors, members).collect()
    assert sorted(r.path for r in rows) == ["p", "p", "p", "p", "q"]
    assert sorted((r.path, *m) for r in rows for m in r.people) == want
