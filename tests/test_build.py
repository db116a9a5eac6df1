"""A small source tree from files to answers."""

import pytest

from graphloom import api
from graphloom.sources import build

TREE = {
    "shop/order.py": "from shop.base import Base\n\nclass Order(Base):\n    def total(self):\n        return _add(1)\n\ndef _add(x):\n    return x\n\ndef _unused(x):\n    return x\n",
    "shop/base.py": "class Base:\n    def save(self):\n        return 1\n", "tests/test_order.py": "from shop.order import Order\n\ndef test_total():\n    Order().total()\n", "lib/pay.go": "package lib\n\ntype Payer interface {\n}\n\ntype Card struct {\n}\n\nfunc (c *Card) Pay(n int) error {\n\treturn check(n)\n}\n\nfunc check(n int) error {\n\treturn nil\n}\n",
    "lib/pay_test.go": "package lib\n\nfunc TestPay() {\n\tcheck(1)\n}\n", "requirements.txt": "flask\n", "skip.bin": "x",
}


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for path, content in TREE.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(content)
    commits = spark.createDataFrame([(c, p) for c in range(3) for p in ("shop/order.py", "lib/pay.go")], "commit_id long, path string")
    return build.scan(spark, str(root), commits=commits)


def named(index):
    return {r.symbol_id: r.qualified for r in index.graph.symbols.collect()}


def test_build(index):
    n = named(index)
    edges = {(n.get(r.source_id), n[r.target_id], r.kind) for r in index.graph.edges.collect()}
    assert {("Order", "Base", "inherits"), ("Order.total", "_add", "calls"), ("Card.Pay", "check", "calls"), ("TestPay", "check", "calls"), ("test_total", "Order", "calls")} <= edges
    assert any(k == "tests" and a == "TestPay" and b == "Card" for a, b, k in edges) and any(k == "temporal" for _, _, k in edges)
    assert [r.name for r in index.frameworks.collect()] == ["Flask"]
    assert {r.language for r in index.graph.files.collect()} == {"python", "go"}


def test_answers(index):
    tools = api.Tools(index.graph, index.names, index.frameworks)
    dead = {r.qualified: (r.verdict, r.reason) for r in tools.dead().parts["symbols"].collect()}
    assert dead["_unused"] == ("dead", None) and "_add" not in dead
    assert tools.call("blast", target="_add", hops=2).parts["risk"].first().total >= 1
    assert tools.graph("Order").parts["categories"].count() >= 1
    assert tools.graph("Nowhere_at_all").choices is not None
    assert tools.search("order total").parts["results"].count() > 0
    assert tools.status().parts["doctor"].where("n > 0").count() == 0
    diff = "diff --git a/shop/order.py b/shop/order.py\n--- a/shop/order.py\n+++ b/shop/order.py\n@@ -7,2 +7,2 @@\n-x\n+y\n"
    assert tools.blast(diff=diff).parts["union"].count() >= 1
