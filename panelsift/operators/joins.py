"""Joins of users, completions, tasks, devices and studies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelsift.columns import c, exclude, existing
from panelsift.operators.skew import (
    HotKeys, attach_facts, find_hot_key_sets, lookup_join, salted_join,
)
from panelsift.operators.windows import task_seconds

# Device columns that get a prefix when joined, and the study
# columns carried over to completions.
PREFIXED_DEVICE_COLUMNS = ("date_created", "respondent_pk", "hardware", "manufacturer", "os")
STUDY_COLUMNS = (
    "task_pk",
    "balance_respondentPk",
    "wonky_study_count",
    "request-remote-addr",
    "task_targeting_type",
    "exposure_band",
)


USER_JOINS = ("inner", "left", "right", "outer", "left_semi", "left_anti")


def _own_columns(user_df: DataFrame, task_complete_df: DataFrame) -> DataFrame:
    """Completions without the columns the users have as well."""
    return exclude(task_complete_df, set(user_df.columns) - {"respondentPk"})


def _with_device(profile: DataFrame, device_df: DataFrame | None, taken: set[str]) -> DataFrame:
    if device_df is None:
        return profile
    prefixed = device_df.withColumnsRenamed({n: f"ditr_{n}" for n in PREFIXED_DEVICE_COLUMNS})
    prefixed = exclude(prefixed, {*taken, *profile.columns})
    return profile.join(prefixed, F.col("respondent_pk") == F.col("ditr_respondent_pk"), "left")


def join_user_task_respondent(
    user_df: DataFrame,
    task_complete_df: DataFrame,
    respondent_info_df: DataFrame,
    device_df: DataFrame | None = None,
    join_type: str = "inner",
    hot: HotKeys | None = None,
) -> DataFrame:
    """One row per completion with user, profile and device columns.

    The three respondent-level sides are joined to each other first, so the
    completions are shuffled once, with hot respondents spread out. Of columns with
    the same name the first in the order user, completion, profile, device is kept.

    The type holds for users with completions and for these with profiles: ``left`` keeps
    all users; ``right`` all profiles, those without an active user with profile columns
    only; ``outer`` all users, completions and profiles; ``left_semi`` and ``left_anti``
    give the users that have both a completion and a profile, or neither of them.
    """
    if join_type not in USER_JOINS:
        raise ValueError(f"join_type must be one of {', '.join(USER_JOINS)}")
    active = task_complete_df.select(F.col("respondentPk").alias("respondent_pk")).distinct()
    if join_type in ("left_semi", "left_anti"):
        chosen = user_df.join(active, "respondent_pk", join_type).join(
            respondent_info_df.select("respondent_pk").distinct(), "respondent_pk", join_type
        )
        return _with_device(chosen, device_df, set())
    done = _own_columns(user_df, task_complete_df)
    taken = {*user_df.columns, *done.columns} - {"respondent_pk"}
    all_users = join_type in ("left", "outer")
    profile = user_df.join(
        exclude(respondent_info_df, taken), "respondent_pk", "left" if all_users else "inner"
    )
    profile = _with_device(profile, device_df, taken)
    keyed = profile.withColumn("__respondent", F.col("respondent_pk"))
    columns = [*user_df.columns, *done.columns]
    columns += [n for n in profile.columns if n not in user_df.columns]
    done = done.withColumn("__respondent", F.col("respondentPk"))
    if join_type != "outer":
        done = done.where(F.col("__respondent").isNotNull())
    joined = salted_join(
        done, keyed, ["__respondent"], "left" if join_type == "outer" else "inner", hot
    ).select(*[c(n) for n in columns])
    if all_users:
        idle = profile.join(active, "respondent_pk", "left_anti")
        joined = joined.unionByName(idle, allowMissingColumns=True)
    if join_type in ("right", "outer"):
        met = user_df.select("respondent_pk").distinct()
        if join_type == "right":
            met = met.join(active, "respondent_pk", "left_semi")
        alone = respondent_info_df.join(met, "respondent_pk", "left_anti")
        alone = exclude(alone, {*taken, "respondent_pk"})
        joined = joined.unionByName(alone, allowMissingColumns=True)
    return joined


def respondent_table(
    user_df: DataFrame,
    task_complete_df: DataFrame,
    respondent_info_df: DataFrame,
    device_df: DataFrame | None,
    study_df: DataFrame,
) -> DataFrame:
    """One row per user with a profile: all that is known per respondent, for one join.

    User, profile and device columns, ``wonky_user_flag``, and for respondents with
    completions ``__respondent`` and ``task_completed``. Completions and study rows are
    combined per respondent before they move. Everything is partitioned by respondent.
    """
    done = _own_columns(user_df, task_complete_df)
    taken = {*user_df.columns, *done.columns} - {"respondent_pk"}
    profile = user_df.join(exclude(respondent_info_df, taken), "respondent_pk", "inner")
    profile = _with_device(profile, device_df, taken)
    counts = _completion_counts(task_complete_df)
    joined = profile.join(counts, F.col("respondent_pk") == F.col("__respondent"), "left")
    joined = joined.join(_members(study_df), F.col("respondent_pk") == F.col("__member"), "left")
    # repeated users or profiles repeat the completions, so these count as often
    copies = F.count(F.lit(1)).over(Window.partitionBy("respondent_pk"))
    return joined.withColumns(
        {
            "task_completed": F.col("task_completed") * copies,
            "wonky_user_flag": F.coalesce(F.col("wonky_user_flag"), F.lit(0)),
        }
    ).drop("__member")


def _completion_counts(task_complete_df: DataFrame) -> DataFrame:
    return task_complete_df.groupBy(F.col("respondentPk").alias("__respondent")).agg(
        F.count("taskPk").alias("task_completed")
    )


def _members(study_df: DataFrame) -> DataFrame:
    members = study_df.select(F.col("balance_respondentPk").alias("__member"))
    return members.where("__member IS NOT NULL").distinct().withColumn("wonky_user_flag", F.lit(1))


def join_panel(
    task_complete_df: DataFrame,
    tasks_df: DataFrame,
    study_df: DataFrame,
    respondents: DataFrame | None = None,
    user_columns: Sequence[str] = (),
    dedupe: bool = False,
    hot: HotKeys | None = None,
    hot_pairs: HotKeys | None = None,
) -> DataFrame:
    """Completions with task, study and respondent columns, shuffled twice at most.

    Gives the rows and columns of the user join (inner), the task counts, the task metadata
    and the study merge (left) one after the other, but joins the studies while the
    completions are still narrow, and then all respondent-level columns, counts among them,
    in one join. ``respondents`` comes from :func:`respondent_table` and ``user_columns``
    are those of the user table; without it, the completions' own respondents are taken.
    """
    if hot is None or hot_pairs is None:
        found = find_hot_key_sets(task_complete_df, [["respondentPk"], ["respondentPk", "taskPk"]])
        hot, hot_pairs = hot or found[0], hot_pairs or found[1]
    given = respondents is not None
    done = exclude(task_complete_df, set(user_columns) - {"respondentPk"})
    facts = ["task_completed", "wonky_user_flag"]
    side = [n for n in respondents.columns if n not in {*facts, "__respondent"}] if given else []
    first = [n for n in side if n in set(user_columns)]
    base = [*first, *done.columns, *[n for n in side if n not in set(user_columns)]]
    tasked = merge_task_metadata(done, tasks_df)
    listed = [*base, "task_time_taken_s", "task_completed", *tasked.columns[len(done.columns) :]]
    study, names = _study_columns(study_df, set(listed), dedupe)
    pair = {"__respondent": F.col("respondentPk"), "__task": F.col("taskPk")}
    if given:
        tasked = tasked.where(F.col("respondentPk").isNotNull())
    rows = salted_join(tasked.withColumns(pair), study, [*pair], "left", hot_pairs)
    if given:
        rows = salted_join(rows, respondents, ["__respondent"], "inner", hot)
    else:
        counts = _completion_counts(task_complete_df)
        known = counts.join(_members(study_df), F.col("__respondent") == F.col("__member"), "left")
        known = known.withColumn("wonky_user_flag", F.coalesce(F.col("wonky_user_flag"), F.lit(0)))
        rows = attach_facts(rows, ["__respondent"], known.drop("__member"), hot)
    made = {
        "task_time_taken_s": task_seconds("date_completed", "date_created"),
        "user_task_pk": _pair_key(),
        "_merge": F.when(F.col("__found") == 1, "both").otherwise("left_only"),
    }
    order = [*listed, "wonky_user_flag", "user_task_pk", *names, "_merge"]
    return rows.withColumns(made).select(*[c(n) for n in order])


def join_study_balance_with_task(
    balance_df: DataFrame,
    task_df: DataFrame,
    balance_survey_col: str = "survey_pk",
    task_origin_id_col: str = "task_origin_id",
    join_type: str = "inner",
) -> DataFrame:
    """Study rows with their task's columns, for the union of all studies at once."""
    left = balance_df.withColumn("__survey", c(balance_survey_col))
    right = task_df.withColumn("__survey", c(task_origin_id_col))
    return lookup_join(left, right, ["__survey"], join_type).drop("__survey")


def label_studies(balance: DataFrame, labels: dict[str, bool]) -> DataFrame:
    """Tag study rows 1 (flagged) or 0 (control) and drop unlabelled studies.

    The labels come from the config, so they travel as literals of one expression.
    """
    chosen = [u for u, is_flagged in labels.items() if is_flagged]
    return balance.where(F.col("uuid").isin(*labels)).withColumn(
        "wonky_study_count", F.when(F.col("uuid").isin(*chosen), 1).otherwise(0)
    )


def add_membership_flag(
    df: DataFrame,
    key: str,
    members: DataFrame,
    member_key: str,
    name: str,
    hot: HotKeys | None = None,
) -> DataFrame:
    """1 when the key occurs among the members, else 0."""
    keys = members.select(c(member_key).alias("__member")).where(F.col("__member").isNotNull())
    keys = keys.distinct().withColumn(name, F.lit(1))
    marked = salted_join(df.withColumn("__member", c(key)), keys, ["__member"], "left", hot)
    return marked.withColumn(name, F.coalesce(c(name), F.lit(0))).drop("__member")


def _pair_key():
    return F.concat_ws("_", F.col("respondentPk").cast("string"), F.col("taskPk").cast("string"))


def _study_columns(study_df: DataFrame, clash: set[str], dedupe: bool) -> tuple[DataFrame, list[str]]:
    """Study rows keyed for the merge, and the names their columns get there."""
    carried = existing(study_df, STUDY_COLUMNS)
    study = study_df.select(*[c(n) for n in carried])
    if dedupe:
        keys = ["balance_respondentPk", "task_pk"]
        study = study.groupBy(*keys).agg(
            *[
                (F.sum(c(n)) if n == "wonky_study_count" else F.max(c(n))).alias(n)
                for n in carried
                if n not in keys
            ]
        )
    names = [f"{n}_wonky" if n in clash else n for n in study.columns]
    study = study.select(
        F.col("balance_respondentPk").alias("__respondent"),
        F.col("task_pk").alias("__task"),
        *[c(n).alias(m) for n, m in zip(study.columns, names)],
        F.lit(1).alias("__found"),
    )
    return study, names


def merge_study_data_with_user_info(
    user_info_df: DataFrame,
    study_df: DataFrame,
    how: str = "left",
    dedupe: bool = False,
    hot: HotKeys | None = None,
    hot_pairs: HotKeys | None = None,
) -> DataFrame:
    """Completions with the study columns of the same respondent and task.

    Adds the composite ``user_task_pk``, a respondent-level ``wonky_user_flag`` and
    the ``_merge`` indicator. A completion in several study groups is repeated
    once per group unless ``dedupe`` first sums the groups per respondent and task.
    ``right`` and ``outer`` also keep study rows no completion meets, with null
    completion columns. ``hot`` and ``hot_pairs`` are known hot respondents and
    (respondent, task) pairs.
    """
    if how not in ("left", "inner", "right", "outer"):
        raise ValueError("how must be 'left', 'inner', 'right' or 'outer'")
    study, _ = _study_columns(study_df, set(user_info_df.columns), dedupe)
    flagged = add_membership_flag(
        user_info_df, "respondentPk", study_df, "balance_respondentPk", "wonky_user_flag", hot
    )
    keyed = flagged.withColumns(
        {
            "user_task_pk": _pair_key(),
            "__respondent": F.col("respondentPk"),
            "__task": F.col("taskPk"),
        }
    )
    pair = ["__respondent", "__task"]
    kept = "left" if how in ("left", "outer") else "inner"
    merged = salted_join(keyed, study, pair, kept, hot_pairs)
    if how in ("right", "outer"):
        # distinct pairs are combined before the shuffle, so a hot one is a single row
        met = keyed.select(*pair).distinct()
        alone = study.join(met, pair, "left_anti").withColumn("__found", F.lit(2))
        merged = merged.unionByName(alone, allowMissingColumns=True)
    indicator = (
        F.when(F.col("__found") == 1, "both")
        .when(F.col("__found") == 2, "right_only")
        .otherwise("left_only")
    )
    return merged.withColumn("_merge", indicator).drop("__respondent", "__task", "__found")


def merge_task_metadata(
    user_info_df: DataFrame, tasks_df: DataFrame, task_cols: Sequence[str] | None = None
) -> DataFrame:
    """Add task columns to completions by task key, without a second key column."""
    wanted = list(task_cols or ("task_pk", "task_length_of_task"))
    if "task_pk" not in wanted:
        wanted.insert(0, "task_pk")
    tasks = tasks_df.select(*[c(n) for n in existing(tasks_df, wanted)])
    tasks = tasks.withColumnRenamed("task_pk", "__task")
    joined = lookup_join(user_info_df.withColumn("__task", F.col("taskPk")), tasks, ["__task"])
    return joined.drop("__task")


def summary_with_task_totals(
    summary: DataFrame, user_info_df: DataFrame, id_col: str = "balance_respondentPk"
) -> DataFrame:
    """Respondent summary with the respondent's distinct completion totals."""
    totals = respondent_task_totals(user_info_df).withColumn("__respondent", F.col("respondentPk"))
    keyed = summary.withColumn("__respondent", c(id_col))
    return salted_join(keyed, totals, ["__respondent"], "left").drop("__respondent")


def respondent_task_totals(user_info_df: DataFrame) -> DataFrame:
    """Distinct (respondent, task count) pairs."""
    return user_info_df.select("respondentPk", "task_completed").distinct()


def outer_join_results(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Full outer join of two result tables that have one row per feature."""
    return left.join(right, list(keys), "full_outer")
