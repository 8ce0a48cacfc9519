"""Fixed values that decide results: word lists, patterns, messages, weights.

Every operator takes these as parameters; the values here are only defaults.
Patterns use Java syntax; ``(?U)`` makes the word classes Unicode-aware.
"""

# --- Fixed values: brands profiled side by side ---------------------------------------------
PROFILE_BRANDS = (
    "AmazonHelp",
    "AppleSupport",
    "SpotifyCares",
    "Delta",
    "AmericanAir",
    "Uber_Support",
    "XboxSupport",
    "Tesco",
    "SprintCare",
)

# --- Fixed values: profiling patterns -------------------------------------------------------
PROFILE_SIGNATURE = r"(?U)(\^[A-Za-z]{1,4}|-[A-Za-z]{2,4}|/[A-Za-z]{2,4}|\b\^[A-Z]{1,3}\b)"
PROFILE_DEFLECTION = (
    r"(?iU)(please\s+(send|dm|direct\s+message)|send\s+us\s+a\s+dm|dm\s+us\s+your|via\s+dm|inbox\s+us"
    r"|reach\s+out\s+in\s+dm|follow\s+and\s+dm|dm\s+for\s+assistance)"
)

# --- Fixed values: masking patterns and tokens ----------------------------------------------
URL = (
    r"https?://(?:www\.)?[-a-zA-Z0-9@:%._+~#=]{1,256}\.[a-zA-Z0-9()]{1,6}\b"
    r"(?:[-a-zA-Z0-9()@:%_+.~#?&/=]*)"
)
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,7}\b"
PHONE = r"(\+?\d{1,3}[-.\s]?)?(\(?\d{3}\)?[-.\s]?)(\d{3}[-.\s]?\d{4})\b"
CARD = r"\b(?:\d[ -]*?){13,16}\b"
BOOKING_CODE = (
    r"(?:confirmation|record\s+locator|conf|booking\s+ref|pnr|reservation\s+#?|code)"
    r"[:\s#]+([A-Z0-9]{6})\b"
)
TICKET = r"\b(?:006|\d{3})[- ]?\d{10}\b"
FLIGHT = r"\b(?:DL|DAL|Flight|Flt|Delta flight|Flight#|FLT#)[:\s#]*(\d{1,4})\b"
HANDLE = r"@([A-Za-z0-9_]+)"
BRAND = "Delta"
BRAND_SITE = "delta.com"
SHORT_SITES = ("bit.ly", "t.co")
TOKEN_BRAND_URL = "<DELTA_OFFICIAL_URL>"
TOKEN_SHORT_URL = "<SHORT_LINK>"
TOKEN_OTHER_URL = "<EXTERNAL_URL>"
TOKEN_EMAIL = "<EMAIL_ADDRESS>"
TOKEN_PHONE = "<PHONE_NUMBER>"
TOKEN_CARD = "<CARD_NUMBER>"
TOKEN_BOOKING = "<PNR_CONFIRMATION_CODE>"
TOKEN_TICKET = "<TICKET_NUMBER>"
TOKEN_HANDLE = "<CUSTOMER_HANDLE>"
FLIGHT_PREFIX = "<FLIGHT_NUM:DL"

# --- Fixed values: agent signature at the end of a reply ------------------------------------
TRAILING_SIGNATURE = r"(?U)(\*[A-Za-z]{1,4}|\^[A-Za-z]{1,4}|-[A-Za-z]{2,4}|/[A-Za-z]{2,4})\s*$"

# --- Fixed values: canned replies -----------------------------------------------------------
CANNED_DM = (
    r"please\s+(?:send|dm|direct\s+message)\s+us",
    r"dm\s+us\s+your\s+(?:confirmation|name|ticket|details|pnr|info)",
    r"reach\s+out\s+(?:to\s+us\s+)?via\s+dm",
    r"follow\s+and\s+dm",
    r"click\s+here\s+to\s+dm",
    r"send\s+a\s+dm\s+with",
)
CANNED_ACKNOWLEDGEMENT = (
    r"thanks\s+for\s+reaching\s+out\s+to\s+delta",
    r"we\s+appreciate\s+your\s+patience",
    r"sorry\s+for\s+any\s+inconvenience\s+caused",
)
CANNED_DM_WORDS = 25
CANNED_ACKNOWLEDGEMENT_WORDS = 15

# --- Fixed values: resolution signals and labels --------------------------------------------
GRATITUDE = (
    r"(?iU)\b(thank\s+you|thanks|thx|appreciate|helpful|sorted|resolved|perfect|awesome"
    r"|great\s+service|got\s+it|all\s+set|kudos)\b"
)
FRUSTRATION = (
    r"(?iU)\b(ridiculous|unacceptable|useless|horrible|worst|still\s+(not|waiting|broken|delayed)"
    r"|never\s+again|lawyer|sue|complaint|terrible|incompetent|disgusted|joke|unhelpful)\b"
)
RESOLUTION = {
    "deflected": (
        0.20,
        "DEFLECTED_UNVERIFIED",
        "Pure canned DM redirect; resolution occurred off-channel without public verification.",
    ),
    "no_reply": (0.0, "NO_BRAND_REPLY", "No brand response found in thread."),
    "thanked": (
        0.95,
        "EXPLICIT_SUCCESS",
        "Customer explicitly expressed gratitude/satisfaction after brand response.",
    ),
    "angry": (
        0.10,
        "FAILED_ESCALATION",
        "Customer expressed continued frustration, anger, or escalated complaint post-reply.",
    ),
    "closed": (
        0.75,
        "IMPLICIT_SUCCESSFUL_CLOSURE",
        "Substantive brand response with no further customer rebuttal (issue closed).",
    ),
    "silent": (
        0.40,
        "AMBIGUOUS_SILENT_CLOSURE",
        "Short or template reply with no follow-up (risk of customer abandonment).",
    ),
    "continued": (
        0.60,
        "MULTI_TURN_CONVERSATIONAL",
        "Active conversational resolution across multiple turns.",
    ),
}
SUBSTANTIVE_REPLY_WORDS = 15

# --- Fixed values: guardrail categories, in order of precedence -----------------------------
GUARDRAIL = (
    (
        "CRITICAL_SAFETY_AND_MEDICAL",
        r"(?iU)\b(paramedics?|ambulance|asthma|heart\s+attack|unconscious|medical\s+emergency|chest\s+pain"
        r"|bleeding|injury|trapped|suffocating|fainted|seizure)\b",
    ),
    (
        "LEGAL_AND_DOT_REGULATORY",
        r"(?iU)\b(lawsuit|attorney|lawyer|sue\s+you|suing|14\s+cfr|part\s+259|dot\s+complaint"
        r"|faa\s+violation|statutory|involuntary\s+denied\s+boarding|legal\s+service)\b",
    ),
    (
        "ADA_AND_MOBILITY_CRITICAL",
        r"(?iU)\b(wheelchair|motorized\s+wheelchair|mobility\s+scooter|assistive\s+device|paralyzed"
        r"|handicapped|ada\s+violation|service\s+dog|guide\s+dog)\b",
    ),
    (
        "SECURITY_AND_ACCOUNT_TAKEOVER",
        r"(?iU)\b(hacked|unauthorized\s+transfer|stolen\s+miles|account\s+takeover|lock\s+my\s+account"
        r"|fraudulent|identity\s+theft|breach)\b",
    ),
    (
        "VULNERABLE_PASSENGER_URGENCY",
        r"(?iU)\b(unaccompanied\s+minor|alone\s+at\s+gate|12\s+year\s+old|lost\s+child|insulin\s+in\s+bag"
        r"|prescription\s+in\s+luggage|medication\s+in\s+bag)\b",
    ),
)

# --- Fixed values: severity words and tier names --------------------------------------------
TIER0_SEVERITY = ("CRITICAL", "LEGAL", "SECURITY")
TIER0_NAME = "TIER_0_MANDATORY_ESCALATION"
TIER1_NAME = "TIER_1_OPERATIONAL_INTENTS"

# --- Fixed values: intent keywords (multi-label tags, substrings) ---------------------------
INTENT_KEYWORDS = (
    ("FLIGHT_DISRUPTION",
     ("delay", "delayed", "cancelled", "cancellation", "missed connection", "stuck", "weather", "gate")),
    ("BAGGAGE_ISSUES",
     ("bag", "baggage", "luggage", "lost bag", "carousel", "damaged bag", "suitcase")),
    ("BOOKING_AND_TICKETING",
     ("ticket", "book", "booking", "seat", "upgrade", "first class", "comfort", "confirmation",
      "change flight")),
    ("REFUNDS_AND_COMPENSATION",
     ("refund", "compensation", "voucher", "ecredit", "credit", "money back", "reimbursement")),
    ("IN_FLIGHT_AND_AIRPORT_SERVICE",
     ("wifi", "internet", "food", "crew", "flight attendant", "gate agent", "screen", "ife", "rude")),
    ("SKYMILES_AND_LOYALTY",
     ("skymiles", "miles", "medallion", "status", "silver", "gold", "diamond", "platinum", "points")),
    ("GENERAL_INQUIRY",
     ("check in", "policy", "travel", "time", "hours", "airport", "carry on", "tsa")),
)

# --- Fixed values: gold rules: (keywords, escalate, intent, rationale), first match wins ----
# In the first rule {} takes the list of words found.
GOLD_RULES = (
    (("emergency", "medical", "ambulance", "hospital", "police", "arrest", "lawsuit", "attorney",
      "lawyer", "minor", "unaccompanied", "wheelchair", "disability", "deaf", "blind", "ada"),
     1, "TIER0_CRITICAL_EMERGENCY",
     "Critical priority indicator detected ({}); involves passenger vulnerability, medical urgency, "
     "ADA mandate, or legal liability."),
    (("delayed 3 hours", "delayed 4 hours", "missed connection", "stranded", "cancelled",
      "stuck at gate", "diverted"),
     1, "FLIGHT_DISRUPTIONS",
     "Severe flight disruption with stranded passenger or missed connection; requires human agent "
     "rebooking and operational duty-of-care assistance."),
    (("lost bag", "damaged suitcase", "broken bag", "missing luggage", "stolen", "didn't show up"),
     1, "BAGGAGE_AND_CARGO",
     "Physical luggage loss or damage incident; requires baggage service desk tracking and formal "
     "claim file creation."),
    (("wrong charge", "double charged", "refund denied", "unauthorized fee",
      "compensation for delay", "send receipt"),
     1, "REFUNDS_CREDITS_COMPENSATION",
     "Disputed financial charge or compensation claim requiring account inspection and "
     "discretionary billing adjustment."),
    (("change my flight to", "rebook me", "emergency change", "standby list"),
     1, "RESERVATIONS_AND_TICKETING",
     "Specific schedule modification request requiring PNR retrieval and ticketing fare class "
     "adjustment."),
    (("thank", "thanks", "great flight", "love delta", "awesome crew", "shoutout", "shout out",
      "best airline"),
     0, "GENERAL_INQUIRY",
     "Positive brand appreciation or compliment with no customer issue or operational ask; "
     "automated acknowledgment is sufficient."),
    (("how much for a checked bag", "baggage fee", "carry on size", "weight limit", "pet fee"),
     0, "BAGGAGE_AND_CARGO",
     "Standard static policy question regarding baggage dimensions or fee schedule; resolvable via "
     "retrieval macro."),
    (("where is the sky club", "lounge hours", "how do i earn miles", "skymiles number",
      "medallion status requirements"),
     0, "SKYMILES_AND_LOYALTY",
     "Informational loyalty program inquiry resolvable via standard knowledge base documentation."),
    (("how do i apply ecredit", "how to book with voucher", "where to enter promo code"),
     0, "REFUNDS_CREDITS_COMPENSATION",
     "Procedural navigation guidance on applying travel credits online; fully resolvable via "
     "self-service link."),
    (("wifi cost", "does this plane have power", "movies on board", "what food is served"),
     0, "AIRPORT_AND_ONBOARD_EXPERIENCE",
     "Routine onboard amenities inquiry resolvable via standard fleet equipment documentation."),
    (("is flight on time", "flight status", "when does dl", "departure time"),
     0, "FLIGHT_DISRUPTIONS",
     "Real-time flight status timestamp request; resolvable via automated flight lookup status bot."),
)
GOLD_NEGATIVE_WORDS = ("angry", "upset", "worst", "terrible", "sue")
GOLD_SHORT_WORDS = 12
GOLD_SHORT = (
    0, "GENERAL_INQUIRY",
    "Short informational inquiry with neutral sentiment; safe for automated retrieval response.",
)
GOLD_OPEN = (
    1, "GENERAL_INQUIRY",
    "Open-ended or complex conversational context with ambiguous intent; human verification "
    "recommended.",
)
GOLD_PREFIX = "GOLD_"

# --- Fixed values: coarse classes from a category name (substrings, upper case) -------------
COARSE_CLASSES = (
    ("FLIGHT_DISRUPTION", ("SAFETY", "MEDICAL", "DISRUPT", "EMERGENCY")),
    ("BAGGAGE_ISSUES", ("BAG",)),
    ("REFUNDS_AND_COMPENSATION", ("LEGAL", "REFUND", "CREDIT", "COMPENSATION")),
    ("SKYMILES_AND_LOYALTY", ("SECURITY", "SKYMILES", "LOYALTY")),
    ("BOOKING_AND_TICKETING", ("RESERVATIONS", "TICKETING", "BOOKING")),
    ("IN_FLIGHT_AND_AIRPORT_SERVICE", ("AIRPORT", "ONBOARD", "EXPERIENCE")),
)
COARSE_DEFAULT = "GENERAL_INQUIRY"

# --- Fixed values: systems under comparison -------------------------------------------------
CONSTANT_SYSTEM = "Baseline 0 (Majority Canned Macro)"
TEMPLATE_SYSTEM = "Baseline 1 (TF-IDF + Static Templates)"
KEYWORD_SYSTEM = "Baseline 2 (Direct Zero-Shot LLM)"
FULL_SYSTEM = "Full System (Taxonomy v2 + Res-Weighted RAG + Calibrated Policy)"
CONSTANT_INTENT = "FLIGHT_DISRUPTION"
CONSTANT_CONFIDENCE = 0.45
CONSTANT_REPLY = (
    "<CUSTOMER_HANDLE> Thanks for reaching out to Delta. Please follow and send us a direct "
    "message with your confirmation code so we can assist. *CS"
)
TEMPLATES = (
    ("FLIGHT_DISRUPTION",
     "<CUSTOMER_HANDLE> We apologize for the flight delay. Please check the Fly Delta app or see a "
     "gate agent for rebooking assistance. *CS"),
    ("BAGGAGE_ISSUES",
     "<CUSTOMER_HANDLE> We are sorry for the baggage trouble. Please visit the Delta baggage service "
     "office in the baggage claim area. *CS"),
    ("BOOKING_AND_TICKETING",
     "<CUSTOMER_HANDLE> For flight booking and seat changes, please visit delta.com or use the Fly "
     "Delta app. *CS"),
    ("REFUNDS_AND_COMPENSATION",
     "<CUSTOMER_HANDLE> To request a refund or check eCredit status, please visit "
     "delta.com/refunds. *CS"),
    ("IN_FLIGHT_AND_AIRPORT_SERVICE",
     "<CUSTOMER_HANDLE> Thank you for your feedback regarding in-flight service. We appreciate your "
     "patience. *CS"),
    ("SKYMILES_AND_LOYALTY",
     "<CUSTOMER_HANDLE> For SkyMiles account inquiries and medallion benefits, please log in at "
     "delta.com/skymiles. *CS"),
    ("GENERAL_INQUIRY",
     "<CUSTOMER_HANDLE> Thanks for contacting Delta. Please check delta.com for travel policies and "
     "information. *CS"),
)
TEMPLATE_DEFAULT_INTENT = "GENERAL_INQUIRY"
TEMPLATE_CUTOFF = 0.35
TEMPLATE_REASON = "Low model confidence cutoff"
# keyword router: (keywords, intent, reply, escalate), first match wins
ROUTER_RULES = (
    (("delay", "cancelled", "missed", "tarmac", "connection"),
     "Flight Interruption / Delay",
     "<CUSTOMER_HANDLE> I apologize for the delay. You can easily rebook your flight on delta.com or "
     "via the app under 'My Trips'. Let me know if you need further help!",
     False),
    (("bag", "baggage", "luggage", "carousel"),
     "Baggage Concern",
     "<CUSTOMER_HANDLE> I'm sorry to hear your bag is delayed. You can track your bag in the Fly "
     "Delta app with your tag number or report it at the baggage desk.",
     False),
    (("hacked", "stolen", "lawsuit", "sue", "paramedic", "asthma", "wheelchair", "unaccompanied"),
     "Urgent Customer Complaint",
     "<CUSTOMER_HANDLE> We take this matter seriously. Please DM us your full details so our team "
     "can look into this immediately.",
     True),
    (("refund", "voucher", "ecredit", "fee"),
     "Billing & Refunds",
     "<CUSTOMER_HANDLE> For refunds and eCredit redemption, please submit a claim at "
     "delta.com/refund-form with your 13-digit ticket number.",
     False),
)
ROUTER_DEFAULT = (
    "General Inquiries",
    "<CUSTOMER_HANDLE> Hello! Thanks for flying with Delta. Please visit delta.com for more "
    "information or let us know how we can assist.",
    False,
)
ROUTER_CONFIDENCE = 0.85
ROUTER_REASON = "LLM detected urgent sentiment"
ROUTED_TIER0_PREFIX = "TIER_0_"
ROUTED_TIER1_INTENT = "TIER_1_OPERATIONAL_INQUIRY"
DISPATCH_REPLY = (
    "<CUSTOMER_HANDLE> This matter has been escalated with priority to our specialist team for "
    "immediate assistance. A dedicated representative is reviewing your details right now. "
    "*DELTA_PRIORITY_DISPATCH"
)
FALLBACK_REPLY = (
    "<CUSTOMER_HANDLE> We're here to help with your travel. Please check your flight status in the "
    "Fly Delta app or share your booking details via DM so we can assist. *CS"
)

# --- Fixed values: costs, weights, cut-offs -------------------------------------------------
COST_MISS = 15.0
COST_FALSE_ALARM = 1.0
THRESHOLDS = tuple(round(0.05 + i * 0.01, 2) for i in range(91))
ALPHA = 0.65
TRUSTED_RESOLUTION = 0.75
WEAK_RESOLUTION = 0.20
WEAK_FACTOR = 0.2
PROTECTION_CUTOFF = 0.40

# --- Fixed values: reply rubric -------------------------------------------------------------
RUBRIC_WEIGHTS = {
    "safety_compliance": 0.35,
    "factual_grounding": 0.30,
    "actionability": 0.20,
    "tone_empathy": 0.15,
}
RUBRIC_EMERGENCY = ("paramedic", "asthma", "heart attack", "14 cfr", "lawsuit", "hacked",
                    "wheelchair", "unaccompanied minor")
RUBRIC_ESCALATED = ("escalat", "specialist")
RUBRIC_SAFE = ("specialist",)
RUBRIC_OVERPROMISE = ("free upgrade", "cash refund guaranteed")
RUBRIC_ADDRESS = ("<CUSTOMER_HANDLE>",)
RUBRIC_CHANNEL = ("app", "delta.com", "flight", "dm")
RUBRIC_ACTION = ("<DELTA_OFFICIAL_URL>", "<SHORT_LINK>", "Fly Delta app", "DM", "direct message",
                 "desk", "counter", "specialist")
RUBRIC_KIND = ("apologize", "sorry", "delighted", "happy to help", "assist", "welcome")
RUBRIC_TEXT = {
    "emergency_escalated": (5.0, "Perfect fail-safe escalation for safety/legal emergency."),
    "emergency_missed": (1.0, "CRITICAL FAILURE: Attempted automated bot reply on emergency query."),
    "claim_escalated": (5.0, "Appropriate escalation for complex claim requiring human authority."),
    "self_service": (5.0, "Appropriately resolved via automated self-service."),
    "misrouted": (
        3.5, "Suboptimal routing (over-escalated or slightly under-escalated non-emergency)."),
    "safe_routing": (5.0, "Safe routing without speculative policy claims."),
    "overpromise": (1.5, "Hallucinated unauthorized customer benefit."),
    "grounded": (4.8, "Grounded in standard verified airline operational channels."),
    "vague": (3.0, "Vague general advice with weak grounding."),
    "action": (4.8, "Provides explicit, concrete next step / contact channel."),
    "no_action": (2.0, "Lacks concrete actionable next steps."),
    "kind": (4.7, "Professional, empathetic, and de-escalating."),
    "dry": (3.0, "Dry or transactional tone."),
}
PENALTY_WORDS = 60
PENALTY_STEP = 0.01
PENALTY_MAX = 0.4
SCORE_TIERS = (("POOR", 3.0), ("SATISFACTORY", 4.3))
SCORE_TOP_TIER = "EXCELLENT"
KAPPA_BANDS = ((0.80, "Near-Perfect Agreement"), (0.60, "Substantial Agreement"),
               (0.40, "Moderate Agreement"))
KAPPA_LOW = "Fair / Weak Agreement"
LARGE_DELTA = 1.5
