"""Membership security for all users at once.

A user sees the values of a secured column that any of the user's groups may see. Users with the same groups
are one policy class, and what a class sees is computed once for all its users. The rows are first grouped
by the secured column and what the question needs (see sheets), and only these groups meet the classes' values, so neither a
large class nor a frequent value brings rows together. A user without a group, and a group without a value, sees nothing.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..formulas.syntax import Refused
from .sheets import Question, Sheet


def policy_classes(members: DataFrame) -> DataFrame:
    """user, policy: users with the same groups have the same policy. members: user, group, in any number and order."""
    groups = members.where("user IS NOT NULL AND `group` IS NOT NULL").groupBy("user").agg(F.array_sort(F.collect_set("group")).alias("groups"))
    return groups.select("user", F.sha2(F.array_join(F.transform("groups", lambda g: F.concat(F.length(g), F.lit(":"), g)), ""), 256).alias("policy"), "groups")


def policy_values(users: DataFrame, allowed: DataFrame) -> DataFrame:
    """policy, value: what each policy sees. users: policy_classes(); allowed: group, value."""
    groups = users.select("policy", "groups").distinct().select("policy", F.explode("groups").alias("group"))
    return groups.join(allowed.where("value IS NOT NULL").distinct(), "group").select("policy", "value").distinct()


def for_all_users(sheet: Sheet, question: Question, column: str, members: DataFrame, allowed: DataFrame) -> DataFrame:
    """user, and the question's answer from the rows that this user may see."""
    if column not in sheet.scope.columns:
        raise Refused(f"security of an unknown column [{column}]")
    users = policy_classes(members)
    values = policy_values(users, allowed).select(F.col("policy").alias("_role"), F.col("value").cast(sheet.scope.types[column]).alias("_value"))
    answers, refused = sheet.answers({"all": replace(question, policy=(column, values))})
    if refused:
        raise Refused(refused["all"])
    out = answers["all"].withColumnRenamed("_role", "policy")
    return users.select("user", "policy").join(out, "policy").drop("policy")
