"""Values shared by the jobs.

Everything under "fixed values" is part of the data format: label names, edge
verbs, render order and sentinels have to be spelled exactly like this for
results to agree with existing inputs and outputs.
"""

# --- fixed values: node labels -------------------------------------------------
EVIDENCE = "EvidenceNode"
ACTOR = "Actor"
DECISION = "DecisionNode"
RATIONALE = "RationaleNode"
EVENT = "Event"
ACTIVITY = "Activity"
CASE = "ProcessInstance"
CLUSTER = "ActivityCluster"

HELPER_LABELS = ["__Entity__", "__KGBuilder__", "inline_text"]
LEAKY_LABELS = [EVENT, ACTIVITY]
BOUNDARY_LABELS = [CASE, CLUSTER, ACTOR]
CASE_LINK_LABELS = [EVIDENCE, DECISION, RATIONALE, CLUSTER]

# --- fixed values: node properties ---------------------------------------------
CASE_ID_KEYS = ["external_system_id", "ocel_object_id", "name", "id"]
RENDER_KEYS = [
    "name", "final_choice", "decision_type", "outcome_status",
    "decision_status", "frequency", "actor_type", "confidence", "text",
]
TEXT_VECTOR = "text_embedding"
STRUCT_VECTOR = "fastrp_embedding"

# --- fixed values: edges ---------------------------------------------------------
EXECUTION_VERBS = ["prepared", "reviewed", "ran", "completed", "approved", "signed_off"]
NEUTRAL_VERB = "linked_to"

# --- fixed values: rendering -----------------------------------------------------
LABEL_TAG = {
    EVIDENCE: "E", ACTOR: "A", DECISION: "D", RATIONALE: "R",
    EVENT: "EV", ACTIVITY: "ACT", CASE: "P", CLUSTER: "AC",
}
OTHER_TAG = "N"
LABEL_RANK = {
    EVIDENCE: 0, CLUSTER: 1, CASE: 2, ACTIVITY: 3,
    DECISION: 4, RATIONALE: 5, EVENT: 6, ACTOR: 7,
}
OTHER_RANK = 8
RENDER_CLIP = 4000
HIT_CLIP = 2000

# --- fixed values: scoring -------------------------------------------------------
INSERT = "__insert__"
DELETE = "__delete__"
MEAN_METRICS = [
    "normalized_edit_distance", "multiset_f1", "multiset_precision", "multiset_recall",
    "seq_f1", "seq_precision", "seq_recall", "jaccard", "lcs_ratio", "length_bias",
]

# --- fixed values: event log -----------------------------------------------------
EMAIL_ACTIVITY = "internal_email_sent"
REDACTED = "[redacted]"

# --- fixed values: defaults of the retrieval settings ----------------------------
OWNER_HOPS = 4
CONTEXT_HOPS = 2
MIN_GRAPH_COVERAGE = 0.9
