import json
import random

import pytest

from loomlake.functions import jsontree as J

DEEP = 20_000


def nested(depth: int, inside: str = '{"<|value|>":"v","<|bbox|>":[0,0,1,1]}') -> str:
    return '{"a":[' * depth + inside + "]}" * depth


def unwrap(obj):
    n = 0
    while isinstance(obj, (dict, list)) and "a" in obj or isinstance(obj, list):
        obj = obj["a"] if isinstance(obj, dict) else obj[0]
        n += 1
    return n, obj


@pytest.mark.parametrize("depth", [3, 3000, DEEP])
def test_labels_of_any_depth(depth):
    tree = J.loads(nested(depth))
    assert J.dumps(tree) == nested(depth)
    leaf = lambda fn: unwrap(J.loads(J.dumps(fn(tree))))
    assert leaf(J.blank) == leaf(J.target_schema) == (2 * depth, {"<|value|>": "", "<|bbox|>": []})
    assert leaf(J.tree_schema) == (2 * depth, {"<|value|>": "str", "<|bbox|>": ["int"]})
    assert leaf(lambda t: J.scale_boxes(t, 30, 20)) == (2 * depth, {"<|value|>": "v", "<|bbox|>": [0, 0, 30, 20]})
    assert leaf(J.remove_key) == (2 * depth, {"<|value|>": "v"})
    assert J.key_boxes(tree) == [("a", "v", [0.0, 0.0, 1.0, 1.0])]
    assert unwrap(J.parse(nested(depth).replace('"', "'").replace("[0", "(0").replace("1]", "1)")))[0] == 2 * depth


def test_columns_of_deep_labels(spark):
    df = spark.createDataFrame([(nested(DEEP), 10, 20), (nested(2), 10, 20), ("no", 1, 1), (None, 1, 1)], "t string, w int, h int")
    got = df.select(J.json_remove_none("t").alias("a"), J.json_target_schema("t").alias("b"), J.json_denormalize("t", "w", "h").alias("c"), J.json_key_boxes("t").alias("d"), J.json_parse("t").alias("e")).collect()
    assert got[0].a == nested(DEEP) == got[0].e and len(got[0].d) == 1
    assert got[0].b == nested(DEEP, '{"<|value|>":"","<|bbox|>":[]}') and got[0].c == nested(DEEP, '{"<|value|>":"v","<|bbox|>":[0,0,10,20]}')
    assert got[2].a is None and got[2].e == "{}" and got[3].a is None


def test_own_reader_against_json():
    r = random.Random(0)

    def tree(d):
        k = r.randrange(8 if d else 6)
        if k < 6:
            return r.choice([None, True, False, 1, -2.5e3, "", 'a"\\\n,:{}[]', "é😀", "'"])
        return [tree(d - 1) for _ in range(r.randrange(4))] if k == 6 else {r.choice(["a", "b", "<|value|>", ""]): tree(d - 1) for _ in range(r.randrange(4))}

    for _ in range(800):
        t = tree(5)
        for text in (json.dumps(t), json.dumps(t, indent=1)):
            assert J._deep(text, json.loads) == t
        text = json.dumps(t)
        i = r.randrange(len(text))
        for broken in (text[:i] + text[i + 1 :], text[:i] + r.choice(",:[]{}") + text[i:], text[:i]):
            try:
                want = json.loads(broken)
            except ValueError:
                with pytest.raises(ValueError):
                    J._deep(broken, json.loads)
            else:
                assert J._deep(broken, json.loads) == want
