"""Prompt tables: one row per record, assembled from columns.

Text is put together by concatenation, never by replacing markers in text that
already holds record content. Block headings, the marker words of the timeline
and the answer format are fixed values; the sentences around them are ours.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseweave.functions.text import objects_list, strip, timeline_text
from caseweave.sources.records import Catalog, catalog_text

# --- fixed values: headings and answer format ------------------------------------
EMAIL_HEADING = "=== EMAIL ==="
TIMELINE_HEADING = "=== OCEL CONTEXT (observed case timeline) ==="
ANSWER_MANY = '{"activities": ["<exact event_type>", ...], "confidence": <number 0-1>, ' \
              '"reasoning": "<one short sentence>"}'
ANSWER_ONE = '{"activities": ["<exact event_type>"], "confidence": <number 0-1>, ' \
             '"reasoning": "<one short sentence>"}'

SYSTEM = (
    "You analyse business processes. One e-mail of a case stands for a hidden run of events. "
    "List the activities of that run in the order they happened, using catalog names exactly "
    "as written and at least one of them. Take the order from the given sources, not from the "
    "catalog. Answer with JSON only."
)
EMAIL_NOTE = "The status mail sent inside the case. List what its sender reports, in their order."
TIMELINE_NOTE = (
    "Events seen before and after the mail; >>> THIS marks its place. Events on either side are "
    "not part of the answer. Use them only to tell similar activities apart."
)
CATALOG_NOTE = "Catalog of possible activities, one \"<event_type>: <description>\" per line:"


@dataclass(frozen=True)
class GraphNotes:
    """Sentences of the graph prompt, which mention the edges the reader will see."""

    system: str
    masked: str = "Actors are tied to the cluster by linked_to. "
    plain: str = (
        "Actors are tied to the cluster by prepared, reviewed, ran, completed, approved or "
        "signed_off. "
    )
    tools: str = (
        "Look up comparable decisions or rationales by the seed ids, then read the logs and "
        "subgraphs of the cases found. The current case and other samplings of it are refused. "
    )
    decide: str = (
        "Go through the evidence spans in ascending order, decide for each whether it reports "
        "no step, one step or several, and name the catalog activities. "
    )

    def text(self, use_tools: bool, mask: bool) -> str:
        return (
            self.system + " " + (self.masked if mask else self.plain)
            + (self.tools if use_tools else "") + self.decide
            + "Answer with one JSON object: " + ANSWER_MANY
        )


GRAPH = GraphNotes(SYSTEM)


def _task(single: bool, cap: int) -> str:
    if single:
        return (
            "Name the single most relevant activity of the hidden e-mail.\n"
            f"Respond with JSON only:\n{ANSWER_ONE}\nReturn exactly one activity."
        )
    limit = ""
    if cap:
        # fixed value: the sentence of the cap
        word = "activity" if cap == 1 else "activities"
        limit = f" Return AT MOST {cap} {word} - never more than {cap}."
    return (
        "List the activities of the hidden e-mail in the order performed.\n"
        f"Respond with JSON only:\n{ANSWER_MANY}\n"
        "Repeat an activity only if it happened more than once. Never return an empty list."
        + limit
    )


def _block(shown: Column, *parts) -> Column:
    text = F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    return F.when(shown, text).otherwise(F.lit(""))


def user_prompt(
    email: Column, timeline: Column, catalog: Catalog | DataFrame, single: bool = False, cap: int = 0
) -> Column:
    """Catalog, then the e-mail and timeline blocks that have content, then the task."""
    def part(name: str) -> Column:
        return F.coalesce(email[name], F.lit(""))

    sender, subject, body = part("sender"), part("subject"), part("body")
    objects = objects_list(email["objects"])
    has_mail = strip(F.concat(sender, objects, subject, body)) != ""
    mail = _block(
        has_mail, f"{EMAIL_HEADING}\n{EMAIL_NOTE}\nSender : ", sender, "\nObjects: ", objects,
        "\nSubject: ", subject, "\nBody:\n", body, "\n\n",
    )
    log = _block(
        strip(timeline) != "", f"{TIMELINE_HEADING}\n{TIMELINE_NOTE}\n", timeline, "\n\n"
    )
    return F.concat(
        F.lit(f"{CATALOG_NOTE}\n"), catalog_text(catalog), F.lit("\n\n"), mail, log, F.lit(_task(single, cap))
    )


def prompt_key(system: Column, user: Column, cap: int, single: bool, effort: str) -> Column:
    """Hash of everything that decides an answer."""
    return F.sha2(
        F.concat_ws("\u0000", F.lit(str(cap)), F.lit(str(int(single))), F.lit(effort), system, user),
        256,
    )


def _name(records: DataFrame) -> Column:
    return F.coalesce(
        F.nullif("graph_key", F.lit("")), F.nullif("email_uid", F.lit("")), F.lit("?")
    )


def prompts(
    records: DataFrame,
    catalog: Catalog | DataFrame,
    use_email: bool = True,
    use_timeline: bool = True,
    single: bool = False,
    cap: int = 0,
    effort: str = "high",
) -> DataFrame:
    """(record_pos, system, user, prompt_key) of the e-mail and timeline arms."""
    email = F.when(F.lit(use_email) & F.col("has_email"), F.col("email"))
    shown = records.select(
        "record_pos", email.alias("email"),
        timeline_text(F.col("observed_timeline"), use_timeline, _name(records)).alias("timeline"),
    )
    return shown.select(
        "record_pos", F.lit(SYSTEM).alias("system"),
        user_prompt(F.col("email"), F.col("timeline"), catalog, single, cap).alias("user"),
    ).withColumn("prompt_key", prompt_key(F.col("system"), F.col("user"), cap, single, effort))


def to_send(prompts: DataFrame) -> DataFrame:
    """Each distinct prompt once, with how many records share it."""
    return prompts.groupBy("prompt_key").agg(
        F.first("system").alias("system"), F.first("user").alias("user"),
        F.count("*").alias("n_records"), F.min("record_pos").alias("record_pos"),
    )


def share_answers(prompts: DataFrame, answers: DataFrame) -> DataFrame:
    """Answers by prompt key onto every record; ``reused`` on all but the first.

    Only successful answers are shared: of a failed one just the record that
    asked has it.
    """
    firsts = prompts.groupBy("prompt_key").agg(F.min("record_pos").alias("first_pos"))
    joined = (
        prompts.select("record_pos", "prompt_key")
        .join(answers, "prompt_key")
        .join(firsts, "prompt_key")
        .withColumn("reused", F.col("record_pos") != F.col("first_pos"))
        .drop("first_pos")
    )
    return joined.where("error is null or not reused")


def graph_prompts(
    records: DataFrame,
    catalog: Catalog | DataFrame,
    subgraphs: DataFrame,
    seeds: DataFrame,
    use_timeline: bool = True,
    use_tools: bool = True,
    mask: bool = True,
    notes: GraphNotes = GRAPH,
) -> DataFrame:
    """(record_pos, application_id, system, user) of the graph arm.

    *subgraphs* is (asked, status, text) and *seeds* (asked, decisions, rationales)
    as joined lists. A record whose application is unknown says so; one whose
    subgraph has no text has no prompt (``user`` is NULL).
    """
    app = F.coalesce(F.nullif("graph_key", F.lit("")), "case_id", F.lit(""))
    timeline = timeline_text(F.col("observed_timeline"), use_timeline, _name(records))
    joined = (
        records.select("record_pos", app.alias("asked"), timeline.alias("timeline"))
        .join(subgraphs, "asked", "left")
        .join(seeds, "asked", "left")
    )
    none = F.lit("(none)")
    head = F.concat(
        F.lit("List the ordered activities hidden behind the e-mail of application "),
        F.col("asked"), F.lit(f".\n\n{CATALOG_NOTE}\n"), catalog_text(catalog), F.lit("\n\nCurrent application id: "),
        F.col("asked"),
    )
    ids = F.concat(
        F.lit("\nSeed node ids in this application:\n- decisions: "),
        F.coalesce(F.nullif("decisions", F.lit("")), none),
        F.lit("\n- rationales: "), F.coalesce(F.nullif("rationales", F.lit("")), none),
    ) if use_tools else F.lit("")
    graph = F.concat(
        F.lit("\n\nThe case as a graph. Evidence marked span=<n> is the mail, in reading order.\n"),
        F.when(
            F.coalesce("status", F.lit("unknown_id")) == "unknown_id",
            F.concat(F.lit("No application "), F.col("asked"), F.lit(" is in the graph.")),
        ).otherwise(F.col("text")),
    )
    log = _block(
        strip(F.col("timeline")) != "", f"\n\n{TIMELINE_HEADING}\n{TIMELINE_NOTE}\n", F.col("timeline")
    )
    end = (
        "\n\nCompare with similar cases before answering; this case's own log is above."
        if use_tools else "\n\nAnswer from the graph and timeline above."
    )
    return joined.select(
        "record_pos", F.col("asked").alias("application_id"),
        F.lit(notes.text(use_tools, mask)).alias("system"),
        F.concat(head, ids, graph, log,
                 F.lit(f"{end}\n\nRespond with one JSON object: {ANSWER_MANY}")).alias("user"),
    )


def audit(records: DataFrame, prompts: DataFrame, answers: DataFrame) -> DataFrame:
    """Exchange per record: its name, status, error, prompt and response.

    ``status`` is ``ok``, ``failed`` or ``cache-hit``; write it partitioned by it.
    """
    key = strip(F.coalesce(
        F.nullif("graph_key", F.lit("")), F.nullif("email_uid", F.lit("")),
        F.format_string("record_%s", F.col("record_pos").cast("string")),
    ))
    folder = F.translate(key, "/\\", "__")
    status = (
        F.when(F.col("error").isNotNull(), "failed")
        .when(F.col("reused"), "cache-hit").otherwise("ok")
    )
    return (
        records.select("record_pos", folder.alias("folder"))
        .join(prompts.select("record_pos", "system", "user"), "record_pos")
        .join(answers.select("record_pos", "raw", "error", "reused"), "record_pos")
        .select(
            "record_pos", "folder", status.alias("status"), "error", "system", "user",
            F.col("raw").alias("assistant"),
        )
    )
