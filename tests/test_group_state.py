import random

import pytest

from tests.helpers import bag, manifest, same_rows
from twinsieve.operators import group_state
from twinsieve.operators.canonical import duplicate_groups
from twinsieve.workspace import stage

COLUMNS = ["device", "md5", "n_paths", "n_objects", "size", "first_path"]


def inventory(spark, rows):
    return stage(manifest(spark, *rows), "inventory")


def step(objects, groups, before, after):
    changes = stage(group_state.object_changes(before, after), "changes")
    merged = stage(group_state.merged_changes(objects, changes), "merged")
    objects = stage(group_state.updated_objects(objects, changes, merged, after), "objects")
    return objects, stage(group_state.updated_groups(groups, objects, changes), "groups"), merged


def start(rows):
    objects = stage(group_state.content_objects(rows), "objects")
    return objects, stage(group_state.groups_of(objects), "groups")


def test_only_objects_that_lost_their_first_path_are_read_again(spark):
    row = lambda path, inode, md5="a": {"path": path, "inode": inode, "md5": md5, "size": 5}
    before = inventory(spark, [row("a", 1), row("b", 1), row("c", 2), row("d", 2), row("e", 3, "z")])
    after = inventory(spark, [row("b", 1), row("c", 2), row("bb", 2), row("e", 3, "z")])
    objects, groups = start(before)
    objects, groups, merged = step(objects, groups, before, after)
    assert bag(merged, "identity", "is_lost") == {("0:1", True): 1, ("0:2", False): 1}
    assert bag(groups, *COLUMNS) == {(0, "a", 3, 2, 5, "b"): 1}
    assert bag(objects, "identity", "n_paths", "first_path") == {
        ("0:1", 1, "b"): 1, ("0:2", 2, "bb"): 1, ("0:3", 1, "e"): 1,
    }


@pytest.mark.parametrize("seed", range(2))
def test_equals_a_full_count_after_every_run(spark, heat, seed):
    rng = random.Random(seed)

    def scan():
        return [
            {
                "path": f"p{i}",
                "device": rng.choice([0, 0, 1, None]),
                "inode": rng.choice([None, 0, 1, 2, 3]),
                "md5": rng.choice("aaabc") if rng.random() < 0.9 else None,
                "size": rng.choice([None, 4, 4, 9]),
            }
            for i in range(30)
            if rng.random() < 0.8
        ]

    before = inventory(spark, scan())
    objects, groups = start(before)
    for rows in (scan(), [], scan()):
        after = inventory(spark, rows)
        objects, groups, _ = step(objects, groups, before, after)
        assert same_rows(objects, group_state.content_objects(after))
        assert same_rows(groups, duplicate_groups(after))
        before = after


def test_an_unchanged_inventory_has_no_changes(spark):
    rows = inventory(spark, [{"path": "a", "md5": "x", "size": None}, {"path": "b", "md5": "x"}])
    assert group_state.object_changes(rows, rows).isEmpty()


def test_short_changes_leave_the_state_where_it_is(spark):
    rows = inventory(spark, [{"path": f"p{i}", "inode": i + 1, "md5": "x"} for i in range(50)])
    objects, _ = start(rows)
    changes = stage(group_state.object_changes(rows, rows.filter("path <> 'p7'")), "changes")
    merged = stage(group_state.merged_changes(objects, changes), "merged")
    updated = objects.join(changes, group_state.OBJECT, "left_anti")
    plan = updated._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert merged.isEmpty()
