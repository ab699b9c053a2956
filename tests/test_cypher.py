import pytest

from codeweave.plans.cypher import CypherError, cypher


def q(built, text, **params):
    return [tuple(r) for r in cypher(built[2].g, text, **params).collect()]


def test_same_rows_as_the_methods(built):
    assert q(built, "MATCH (a:Symbol)-[c:CALLS]->(b:Symbol {name: $n}) RETURN DISTINCT a.name AS name, c.line AS line ORDER BY name", n="board") == [("Depart", 5), ("board", 12)]
    assert q(built, "MATCH (a:Symbol {name: 'deposit', path: 'ledger.py'})-[c:CALLS]->(b:Symbol) RETURN b.name AS name, c.confidence AS sure ORDER BY name") == [
        ("open_book", "EXTRACTED"), ("round_cents", "EXTRACTED"),
    ]
    walked = q(built, "MATCH (a:Symbol {name:'deposit'})-[:CALLS*1..2]->(b:Symbol) RETURN DISTINCT b.name AS name ORDER BY name")
    assert walked == [("new_page",), ("open_book",), ("round_cents",)]
    assert q(built, "MATCH (a:File)-[:IMPORTS]->(b:File) RETURN a.path AS a, b.path AS b ORDER BY a") == [("ledger.py", "storage.py"), ("ticket.ts", "ledger.py")]
    assert q(built, "MATCH (b:Symbol {name:'Account'})<-[:INHERITS]-(a:Symbol) RETURN a.name AS n") == [("Savings",)]


def test_filters_groups_pages(built):
    assert q(built, "MATCH (s:Symbol) RETURN s.kind AS kind, count(s) AS n ORDER BY n DESC, kind") == [("function", 9), ("class", 3), ("interface", 1), ("method", 1)]
    assert q(built, "MATCH (s:Symbol) WHERE s.kind IN ['class'] AND (s.name STARTS WITH 'A' OR lower(s.name) CONTAINS 'count') RETURN s.name AS n ORDER BY n") == [
        ("Account",), ("Counter",),
    ]
    assert q(built, "MATCH (s:Symbol) WHERE s.doc <> '' RETURN s.name AS n ORDER BY n") == [("Depart",), ("open_book",), ("round_cents",)]
    assert len(q(built, "MATCH (s:Symbol) RETURN s.name AS n ORDER BY n SKIP 12 LIMIT 5")) == 2
    assert q(built, "MATCH ()-[e:CALLS]->() RETURN count(*) AS n") == [(6,)]
    assert q(built, "MATCH (a:Symbol)-[:CALLS|USES]-(b:Symbol {name:'Savings'}) RETURN a.name AS n") == [("Counter",)]
    assert q(built, "MATCH (f:File {path: 'storage.py'}) RETURN f.*")[0][:2] == ("storage.py", "python")
    assert q(built, "MATCH (s:Symbol)-[:DEFINED_IN]->(f:File {path:'storage.py'}) RETURN count(s) AS n") == [(2,)]


def test_paths_and_the_nodes_on_them(built):
    ways = "MATCH (a:Symbol {name:'deposit'})-[e:CALLS* SHORTEST 1..6]->(b:Symbol {name:$b}) RETURN list_transform(nodes(e), n -> n.name) AS mid LIMIT 1"
    assert q(built, ways, b="new_page") == [(["open_book"],)] and q(built, ways, b="open_book") == [([],)] and q(built, ways, b="board") == []
    assert q(built, "MATCH (a:Symbol {name:'board'})-[e:CALLS* SHORTEST 1..3]->(b:Symbol {name:'board'}) RETURN list_transform(nodes(e), n -> n.id) AS mid") == [([],)]
    whole = q(built, "MATCH p=(a:Symbol {name:'Counter'})-[:USES|CALLS|CONTAINS*1..2]->(b) RETURN p LIMIT 100")
    assert sorted([n["name"] for n in p] for (p,) in whole) == [["Counter", "Fare"], ["Counter", "Savings"], ["Counter", "Savings", "deposit"], ["Counter", "sell"], ["Counter", "sell", "price"]]
    assert q(built, "MATCH p=(a:Symbol {name:'sell'})-[:CALLS]->(b) RETURN list_transform(nodes(p), n -> n.name) AS names") == [(["sell", "price"],)]
    with pytest.raises(CypherError):
        q(built, "MATCH (a)-[e:CALLS]->(b) RETURN list_transform(nodes(e), n -> n.name) AS x")


@pytest.mark.parametrize("text", ["MATCH (a)", "MATCH (a:Nope) RETURN a.x", "MATCH (a) RETURN b.name", "MATCH (a)-[:X]->(b) RETURN a.id", "MATCH (a) RETURN a.id LIMIT 1 FOO", "CREATE (a)"])
def test_what_is_not_supported_is_an_error(built, text):
    with pytest.raises(CypherError):
        q(built, text)
