"""Risk weights, triggers, advice tables and message formats (fixed values)."""

# ---- fixed values: base score and multiplier per clause type
BASE_RISK = 3
TYPE_MULTIPLIERS = {
    "liability": 1.8, "termination": 1.5, "payment": 1.3, "intellectual_property": 1.6,
    "confidentiality": 1.2, "duration": 1.1, "internal_maintenance": 1.4,
    "additions_alterations": 1.3, "assignment": 1.2, "dispute_resolution": 1.0,
    "force_majeure": 0.8, "governing_law": 0.9,
}
RISK_FACTOR_POINTS = 1.5

# ---- fixed values: phrases that raise and lower the base score
RISK_PHRASES = {
    "unlimited liability": 4, "sole discretion": 3, "without notice": 2.5,
    "immediate termination": 3, "non-refundable": 2, "auto-renewal": 2,
    "broad indemnification": 3, "no liability cap": 3.5, "waiver of rights": 2.5,
    "mandatory arbitration": 2, "personal guarantee": 2.5, "structural repairs": 2,
    "restoration obligations": 1.5,
}
MITIGATING_PHRASES = {
    "reasonable notice": -0.7, "mutual agreement": -0.8, "written consent": -0.5,
    "good faith": -0.4, "commercially reasonable": -0.9, "industry standard": -0.6,
    "liability cap": -1.0, "cure period": -0.8,
}

# ---- fixed values: phrase, required context words, factor text
CONTEXT_FACTORS = [
    ("unlimited", ["liability", "damages", "responsibility"], "Unlimited liability exposure"),
    ("sole discretion", ["decision", "approval", "consent"], "Unilateral decision-making power"),
    ("without notice", ["terminate", "change", "modify"], "No notice requirement"),
    ("immediate", ["termination", "payment", "action"], "No grace period provided"),
    ("non-refundable", ["deposit", "payment", "fee"], "Non-refundable financial obligations"),
    ("auto-renew", ["lease", "contract", "agreement"], "Automatic renewal without consent"),
]

# ---- fixed values: risk triggers (word, weight, reason, category)
RISK_TRIGGERS = [
    ("unlimited", 4.0, "Creates unlimited liability exposure with no financial protection", "liability"),
    ("sole discretion", 3.5, "Gives one party complete control without checks and balances", "control"),
    ("without notice", 3.0, "Eliminates advance warning and preparation time", "notice"),
    ("immediate", 3.0, "Provides no grace period or time to cure issues", "timing"),
    ("non-refundable", 2.5, "Creates non-recoverable financial obligations", "financial"),
    ("auto-renewal", 2.5, "Forces automatic contract extension without active consent", "duration"),
    ("indemnify", 3.0, "Creates broad obligation to compensate for damages and legal costs", "liability"),
    ("waive", 3.5, "Eliminates important legal rights and protections", "rights"),
    ("perpetual", 3.0, "Creates indefinite obligations with no end date", "duration"),
    ("irrevocable", 3.0, "Prevents future modifications or cancellation", "flexibility"),
    ("personal guarantee", 4.0, "Creates personal liability beyond business obligations", "liability"),
    ("structural repairs", 2.5, "May impose major unexpected maintenance costs", "maintenance"),
    ("no alterations", 2.0, "Severely limits property use flexibility and improvements", "restrictions"),
    ("mandatory arbitration", 2.5, "Limits legal recourse options and jury trial rights", "dispute"),
    ("binding", 2.0, "Creates enforceable obligations that cannot be easily changed", "enforceability"),
    ("forfeit", 3.0, "Risk of losing money or property without compensation", "financial"),
    ("penalty", 2.5, "Additional financial punishment beyond actual damages", "financial"),
    ("exclusive", 2.0, "Limits options and creates dependency on single party", "restrictions"),
]
MITIGATORS = [
    ("reasonable", -0.5, "Provides standard of reasonableness and fairness", "fairness"),
    ("mutual", -0.7, "Creates balanced obligations for both parties", "balance"),
    ("written consent", -0.4, "Requires formal agreement and documentation", "process"),
    ("good faith", -0.6, "Requires honest and fair dealing between parties", "fairness"),
    ("commercially reasonable", -0.8, "Applies industry standard business practices", "standards"),
    ("industry standard", -0.6, "Follows accepted industry practices and norms", "standards"),
    ("liability cap", -1.0, "Limits maximum financial exposure and damages", "protection"),
    ("cure period", -0.8, "Provides time to fix problems before penalties", "fairness"),
    ("notice", -0.5, "Provides advance warning and preparation time", "process"),
]
TRIGGER_SCALE = 0.3
TYPE_TRIGGER_WEIGHT = 2.0
MSG_TYPE_TRIGGER = "%s clause risk factor: %s"

# ---- fixed values: explanation sentences
MSG_RISKS = "Risk factors identified: %d trigger(s) found. "
MSG_KEY_CONCERNS = "Key concerns include %s. "
MSG_MITIGATORS = "Positive factors: %d risk mitigator(s) found including %s. "
MSG_NO_TRIGGER = (
    "No specific risk triggers identified in this %s clause. "
    "Risk assessment based on clause type and content analysis."
)

# ---- fixed values: document score
NO_CLAUSE_RISK = 6.0
MISSING_CRITICAL_POINTS = 0.7
SHORT_TEXT_CHARS = 1000
HIGH_RISK_SHARE = 0.3
HIGH_RISK_POINTS = 0.8

# ---- fixed values: recommendations
MAX_RECOMMENDATIONS = 15
REC_BATCH = (
    "Multiple documents analyzed - ensure all documents are from the same agreement context "
    "and review individual file results"
)
REC_REVIEW = "ACCOUNTABILITY: %d clause(s) flagged for human review due to low confidence scores"
REC_CRITICAL = "URGENT: %d critical clause(s) require immediate legal review before signing"
REC_HIGH_RISK = "%d high-risk clause(s) need negotiation to reduce legal exposure"
REC_MISSING = {
    "duration": "Add clear lease duration clause specifying start date, term length, and renewal terms",
    "internal_maintenance":
        "Include internal maintenance clause defining tenant vs. landlord repair responsibilities",
    "additions_alterations":
        "Add additions/alterations clause governing property modifications and approval requirements",
    "termination": "Include termination clause with clear notice periods and termination conditions",
    "liability": "Add liability limitation clause with caps and exclusions to protect against unlimited exposure",
    "payment": "Define comprehensive payment terms including amounts, due dates, and late payment penalties",
}
REC_MISSING_OTHER = "Consider adding %s clause for comprehensive coverage"
REC_SHORT = "Document appears incomplete - ensure all essential terms are fully specified and documented"
REC_HIGH_MEAN = "Overall high risk level - consider comprehensive legal review before execution"
REC_PRIVACY = "PRIVACY: PII redaction has been applied to protect sensitive information"
REC_FAIRNESS = "FAIRNESS: Consider running a bias audit to ensure fair analysis across different contract types"

# ---- fixed values: summary sentences
SUM_BATCH = "Trust & Safety enhanced batch document analysis reveals "
SUM_SINGLE = "Trust & Safety enhanced AI analysis reveals "
SUM_LEVEL = " risk level (%s/10) with %s clause(s) identified. "
SUM_RENTAL = "Found %d rental-specific clause(s). "
SUM_REVIEW = "%d clause(s) flagged for human review due to low confidence. "
SUM_HIGH = "%d high-risk item(s) require attention. "
SUM_CRITICAL = "%d critical clause(s) need immediate review. "
SUM_MISSING_RENTAL = "Missing %d essential rental clause(s). "
SUM_MISSING = "%d standard clause(s) missing overall. "
SUM_PRIVACY = "Privacy protection and bias mitigation measures have been applied. "
SUM_END = {
    "high": "Recommend comprehensive legal review and negotiation before signing.",
    "medium": "Review highlighted items and consider legal consultation for high-risk clauses.",
    "low": "Document appears relatively balanced but verify alignment with business objectives.",
}

# ---- own wording: advice by clause type and tier, then by tier alone (suggestion, justification)
TIERED_ADVICE = {
    ("liability", "high"): (
        "Agree on a ceiling for damages, for instance the yearly fees, and leave indirect losses out",
        "Without a ceiling one claim may cost more than the whole contract brings"),
    ("liability", "medium"): (
        "Let the same limits hold for both sides, and say which damages count",
        "Limits that bind one side only shift the risk to the other"),
    ("liability", "low"): (
        "Compare the agreed limits with what your insurance covers",
        "A fair clause may still leave a gap that nobody pays for"),
    ("duration", "high"): (
        "Ask for a right to leave early on fair notice, and strike the renewal that needs no action",
        "A long term without a way out ties both money and people"),
    ("duration", "medium"): (
        "Let every extension need the written consent of both sides",
        "An extension that happens by itself is easily overlooked"),
    ("duration", "low"): (
        "Put the end date and the notice date into your calendar",
        "Even a suitable term does harm when its dates are missed"),
    ("internal_maintenance", "high"): (
        "Keep the building's structure and its large installations with the owner",
        "Repairs of that kind cost more than a tenant can foresee"),
    ("internal_maintenance", "medium"): (
        "List the repairs meant, and name an amount from which the owner pays",
        "What isn't listed is what people quarrel about later"),
    ("internal_maintenance", "low"): (
        "Look at the rooms and note their state before agreeing",
        "What has to be kept up depends on how it was handed over"),
}
GENERIC_ADVICE = {
    "high": (
        "Have a lawyer read this clause and ask for other terms before you sign",
        "What it may cost is out of proportion to what it gives"),
    "medium": (
        "Ask that the duty holds for both sides, or that it is limited",
        "One-sided duties are where later disputes begin"),
    "low": (
        "Read it once more with your own plans in mind",
        "Harmless terms can still be in the way"),
}
ADVICE_UNLIMITED = (
    "Name an amount in place of 'unlimited'",
    "Nobody can plan for a duty without an upper end")
ADVICE_SOLE_DISCRETION = (
    "Ask for decisions on reasonable grounds, or by both sides together, in place of 'sole discretion'",
    "One side deciding alone leaves the other without a say")
ADVICE_REVIEW_SUFFIX = " [please have a person check this: the classification is uncertain]"
ADVICE_REVIEW_REASON = " The classification is certain to the level '%s' only."

# ---- own wording: handbook advice overrides and sentences
HANDBOOK_UNLIMITED = (
    "Name an amount in place of 'unlimited', such as one year's fees",
    "Neither side owes the other more than [amount] in total under this contract")
HANDBOOK_SOLE_DISCRETION = (
    "Tie the decision to reasonable grounds and to a date for the answer, in place of 'sole discretion'",
    "The decision is made on reasonable grounds and told in writing within [number] days")
HANDBOOK_LANGUAGE_DEFAULT = "Write down who does what by when, and what follows if not."
HANDBOOK_JUSTIFICATION = "The wording shows the risks listed for %s clauses (certainty of the classification: %s)."
HANDBOOK_OUTCOME = "Less risk from the %s clause"
HANDBOOK_ACTIONS = [
    "Mark the wording that matters",
    "Propose other wording to the other side",
    "Put what was agreed into the text",
]

# ---- own wording of the neutral handbook: opening and closing remark per risk level; `read_handbook` brings others
LEVEL_MODIFIERS = {
    "critical": ("[critical] Have counsel look at this before anything is signed: ", "Do not accept this wording as it stands. "),
    "high": ("[high] Negotiate this early: ", "Expect to change the wording. "),
    "medium": ("[medium] Worth a second look: ", "A clearer wording would lower the exposure. "),
    "low": ("[low] Fine as a rule: ", "Changes here are a matter of taste. "),
}
