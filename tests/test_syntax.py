import random

from weftline.lang.names import Workspace
from weftline.lang.syntax import parse
from weftline.sources.workspace import load

TEXT = '''
import { a, ns::b } from "./other.spec"
//! careful
//? really
namespace crm (note "customers") {
  schema person (pii) {
    id INT (pk, required)
    name STRING(20) (enum {x, "y z"}, note """long
      note""")
    address record { city STRING ...place }
    tags list_of STRING
    lines list_of record (filter kind != "bad") { kind STRING }
  }
  fragment place { street STRING ...more }
  fragment more { zip STRING ...place }
}
transform clean { trim | lowercase }
mapping `people to mart` (group_by id, merge upsert) {
  source { crm::person (filter "id > 3") "joined by @person.id" }
  target { mart }
  id, name -> key { concat }
  -> now { now_utc }
  name -> kind { ...clean | map { A: "a", < 5: "few", null: null, _: "rest" } }
  address -> place { city -> town .street -> way }
  each lines -> rows { .kind -> kind }
}
'''


def test_every_construct():
    m = parse(TEXT, "t.spec")
    assert not m.errors
    assert m.imports == [(["a", "ns::b"], "./other.spec", 1)]
    assert [(k, t) for k, t, _, _ in m.comments] == [("warning", "careful"), ("question", "really")]
    person = next(b for b in m.blocks if b.name == "person")
    assert person.key == "crm::person" and person.tag("pii")
    assert [f.name for f in person.fields] == ["id", "name", "address", "tags", "lines"]
    assert person.fields[1].type == "STRING(20)" and person.fields[1].meta[0].values == ["x", "y z"]
    assert person.fields[4].is_list and person.fields[4].is_record
    mapping = m.blocks[-1]
    assert mapping.name == "people to mart" and mapping.value("group_by") == "id"
    assert [a.kind for a in mapping.arrows] == ["map", "computed", "map", "nested", "each"]
    assert mapping.arrows[2].steps[1].entries == [("", "A", "a"), ("<", "5", "few"), ("", "\0null", None), ("", "\0default", "rest")]
    assert mapping.sources[1].is_prose


def test_spreads_expand_once_and_cycles_are_noted():
    w = Workspace([parse(TEXT)])
    paths = [p for p, _, _ in w.paths("crm::person")]
    assert "address.street" in paths and "address.zip" in paths
    assert w.cycles


def test_errors_are_rows_and_reading_goes_on():
    m = parse("schema broken { a }\nschema fine { b INT }\nschema open { c INT")
    assert [b.name for b in m.blocks] == ["fine"] and len(m.errors) == 2


def test_random_text_never_fails():
    draw = random.Random(1)
    parts = ["schema", "mapping", "{", "}", "(", ")", "->", "a", "`b c`", '"x"', "|", "map", ":", "...", ",", "@", "each", "\n", "::", ".", "list_of", "record", "1.5", "<", "é"]
    for _ in range(500):
        parse(" ".join(draw.choice(parts) for _ in range(draw.randrange(40))))


def test_imports_are_followed_once():
    texts = {"d/a.spec": 'import { x } from "b.spec"\nimport { y } from "gone.spec"', "d/b.spec": 'import { z } from "./a.spec"\nschema x { i INT }'}
    modules = load("d/a.spec", texts)
    assert [m.file for m in modules] == ["d/a.spec", "d/b.spec"]
    assert modules[0].errors[0][2] == "missing import gone.spec"


def test_printing_is_stable():
    from weftline.lang.printer import add_source, to_text

    once = to_text(parse(TEXT))
    again = parse(once)
    assert not again.errors and to_text(again) == once
    first = parse(TEXT)
    strip = lambda fs: [(f.name, f.type, f.is_list, [(m.kind, m.key, m.value, m.values) for m in f.meta], strip(f.children), f.spreads) for f in fs]
    by = lambda m: {b.key: (strip(b.fields), b.spreads, [(a.kind, a.sources, a.target, [s.entries for s in a.steps]) for a in b.arrows]) for b in m.blocks}
    assert by(first) == by(again)
    fixed = add_source("mapping m {\n  source { a }\n}", "m", "b")
    assert fixed == "mapping m {\n  source { a, b }\n}" == add_source(fixed, "m", "b")
