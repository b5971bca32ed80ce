import weakref

import pytest

from tallyfield.llm import common, language


class Fake:
    """A session without a checkpoint folder."""

    def __init__(self, master):
        none = type("None_", (), {"isDefined": lambda self: False})()
        jvm = type("Jvm", (), {"getCheckpointDir": lambda self: none})()
        self.sparkContext = type("Context", (), {"master": master, "_jsc": type("J", (), {"sc": lambda self: jvm})()})()
        self.set = {}
        self.conf = type("Conf", (), {"get": lambda c, k, d=None: self.set.get(k, d), "set": lambda c, k, v: self.set.update({k: v})})()


def test_only_local_mode_makes_its_own_folder():
    fake = Fake("local[4]")
    assert common.scratch(fake) == fake.set["spark.checkpoint.dir"] == common.scratch(fake)
    for master in ("yarn", "spark://h:7077", "local-cluster[3,2,3000]", "k8s://x"):
        with pytest.raises(RuntimeError):
            common.scratch(Fake(master))


def test_a_worker_keeps_one_tool():
    made = []
    first = language.labeller(model := language.Model(["x"]))
    assert language.labeller(model) is first
    assert common.tool("other", lambda: made.append(1) or "other") == common.tool("other", lambda: made.append(1)) == "other" and made == [1]
    gone = weakref.ref(first)
    del first
    assert gone() is None
