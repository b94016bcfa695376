"""Patterns, word lists and constants of the rule engines.

Fixed values: results depend on them to the letter. Patterns are written so that Java's and
RE2's engines read them alike; they are matched against lower-cased text or say (?i).
"""

# Categories, first match wins.
CATEGORY_PATTERNS = (
    ("preference", r"prefer|like |love |hate |dislike|favorite|enjoy|don't like|not a fan"),
    ("project", r"project|building|working on|creating|app |tool |system |repo|github"),
    ("profile", r"name is|my name|called|i am |i'm |works as|role |job "),
    ("request", r"need |want |please |can you|could you|help me"),
    ("learning", r"learn|studying|studied|reading|research|course|tutorial|guide"),
    ("setup", r"tech |stack|language|framework|library|tool |using |installed|setup|config"),
    ("goal", r"goal |aim |plan |want to|going to|will |future"),
    ("issue", r"error|bug|issue|problem|fail|crash|broken|fix"),
    ("pattern", r"workflow|habit|always|usually|typically|every |each "),
    ("entity", r"entity|person|company|website|product|service"),
    ("event", r"yesterday|today|tomorrow|last week|meeting|call |event|schedule"),
)
# Memory types and the importance each starts from.
MEMORY_TYPES = (
    "general", "fact", "preference", "profile", "project", "goal", "pattern", "entity",
    "event", "issue", "setup", "learning", "request", "reflection", "summary",
)
TYPE_IMPORTANCE = {
    "profile": 0.9, "preference": 0.8, "setup": 0.8, "project": 0.75, "goal": 0.7, "issue": 0.6,
    "pattern": 0.65, "fact": 0.5, "event": 0.4, "request": 0.3, "learning": 0.55,
}
BASE_IMPORTANCE = 0.5
CRITICAL = r"critical|essential|important|must|always|never|deadline|urgent"
SECURITY = r"password|secret|api.key|credential|token|auth"
IDENTITY_HINT = r"my name|i am |called |role |job title"
TRIVIAL_OPENER = r"^(ok|okay|sure|yes|no|done|thanks|hi|hello|bye|good)\b"
UNCERTAIN = r"maybe|might|perhaps|possibly"

# Entity and attribute extraction, in order.
_UNTIL = r"(?:\s+(?:for|when|while|because|over|instead|than|rather|$))"
NEGATED_PREFERENCE = (
    r"(?:i |user )?(?:don'?t|do not|not|never|no longer|used to)\s+"
    r"(prefer|like|love|hate|dislike|use|using|favor|choose)\s+(.+?)" + _UNTIL
)
SWITCHED = r"(?:i |user )?(?:switched|moved|changed|migrated)\s+from\s+\S+\s+to\s+(.+?)" + _UNTIL
PREFERENCE = r"(?:i |user )?(prefer|like|love|hate|dislike|use|using|favor|choose|chose)\s+(.+?)" + _UNTIL
IDENTITY = r"(?:my name is|i'?m |i am |i work at|i work for|i'?m at)\s+(.+?)(?:\s*[.!?,;]|\s*$)"
TECH = r"(?:use|using|running|built with|running on|stack is)\s+(\S+)"
PROJECT = r"(?:building|working on|creating|developing|making)\s+(.+?)(?:\s+(?:with|using|for|called|named|\.|!|\?|,|;|$))"

# What a statement says, for contradictions, in order.
VALUE_NEGATED = r"(?:don'?t|do not|not|never|no longer|used to)\s+(?:prefer|like|love|hate|dislike|use|using|favor|choose)\s+(\S+)"
VALUE_PAST = r"(?:used to|previously|formerly|before)\s+(?:prefer|like|love|use|using)\s+(\S+)"
VALUE_SWITCHED = r"(?:switched|moved|changed|migrated)\s+from\s+(\S+)\s+to\s+(\S+)"
VALUE_POSITIVE = r"(?:prefer|like|love|hate|dislike|use|using|favor|choose|chose)\s+(\S+)"
VALUE_IDENTITY = r"(?:my name is|i'?m |i am |call me)\s+(.+?)(?:\s*[.!?,;]|\s*$)"
CONFLICT_VERB = r"(?:prefer|like|love|hate|dislike|use|using|favor|choose)\s+(\S+)"

# Corrections of wrong types, first rule that applies wins. The first two end in a
# literal s; ``fixed`` gives what they meant.
CORRECTIONS = (
    (r"(?:i |user )?(?:prefer|like|love|hate|dislike|favor|choose|can't stand)s", "preference", ("fact", "entity", "pattern")),
    (r"(?:my name|i'?m |i am |call me)s", "profile", ("fact", "entity", "preference")),
    (r"(?:error|bug|issue|fail|crash|broken|exception|stack trace|traceback)", "issue", ("fact", "event", "entity")),
    (r"(?:goal|planning to|want to|intend to|aim to|going to|will build|i need to)", "goal", ("fact", "project")),
    (r"(?:yesterday|last week|on \w+day|at \d{1,2}(?:am|pm)|happened|occurred)", "event", ("fact",)),
    (r"(?:installed|configured|set up|setup|deployed|running on|using version|environment)", "setup", ("fact", "entity")),
    (r"(?:learned|research|according to|documentation says|docs say|web search found)", "learning", ("fact", "entity")),
)

# Relations found in text; the object is the pattern's last group.
EDGE_PATTERNS = (
    (r"(?:i |user )?(?:use|using|prefer|like|love|hate|dislike)\s+(\S.+?)(?:\s+(?:for|when|because|over|instead|than|to|and|$))", "uses", 1),
    (r"(?:i |user )?(?:work(?:ing)? on|build(?:ing)?|creat(?:ing)?|develop(?:ing)?)\s+(\S.+?)(?:\s+(?:with|using|for|called|named|and|$))", "works_on", 1),
    (r"(.+?)\s+(?:belongs to|part of|component of|member of)\s+(.+)", "belongs_to", 2),
    (r"(.+?)\s+(?:causes?|leads? to|results? in|triggers?)\s+(.+)", "causes", 2),
    (r"(.+?)\s+(?:is related to|connect(?:ed|s) to|linked to|associated with)\s+(.+)", "related_to", 2),
)

# Decay by type: scale in days (None: no decay) and shape.
DECAY = {
    "profile": (None, 1.0), "preference": (180.0, 1.2), "setup": (120.0, 1.3), "project": (60.0, 1.4), "goal": (45.0, 1.5),
    "fact": (30.0, 1.0), "learning": (45.0, 1.1), "pattern": (60.0, 1.2), "entity": (90.0, 1.1), "issue": (14.0, 2.0),
    "event": (7.0, 2.5), "request": (3.0, 3.0), "general": (30.0, 1.0),
}

# Query intents, in order; identifier patterns are case-sensitive but for the last.
IDENTIFIER_PATTERNS = (
    r"^[a-z_][a-z0-9_]*(?:[A-Z][a-z0-9_]*)+$",
    r"^[a-z][a-z0-9_]+_[a-z0-9_]+$",
    r"^[\w./-]+\.(py|js|ts|tsx|jsx|mjs|yaml|json|md)$",
    r"^(def |class |function |import |from |const |let |var )",
    r"^[\w.-]+@[\w.-]+$",
    r"(?i)^[0-9a-f]{8,}$",
)
EXACT_PATTERNS = (
    "[\"'`]",
    r"(?i)(GET|POST|PUT|DELETE|PATCH|API|URL|HTTP|CSS|HTML|SQL|JSON|YAML)",
    r"(?i)(error|exception|stack|trace|debug|crash|fail|broken)",
    r"(?i)(fix|bug|issue|ticket|PR|commit|merge|branch)",
)
CONCEPTUAL_PATTERNS = (
    r"(?i)(prefer|like|love|hate|dislike|opinion|think|feel|want|need|should|better|best)",
    r"(?i)(what|how|why|when|where|who|which)",
    r"(?i)(similar|like|related|about|regarding|concerning)",
)
#: (keyword weight, vector weight)
INTENT_WEIGHTS = {"identifier": (0.85, 0.15), "exact": (0.7, 0.3), "conceptual": (0.3, 0.7), "mixed": (0.55, 0.45)}

# Messages that are not stored, and what is stored in any case.
SKIP_PATTERNS = (
    r"(?i)^(ok|okay|sure|yes|no|got it|thanks|thank you|done|continue|go ahead|please|yep|yeah|nope|cool|great|good|fine|right|correct|agreed)$",
    r"(?i)^(hi|hello|hey|good morning|good afternoon|good evening|bye|goodbye|see you)$",
    r"^\s*.{0,4}\s*$",
)
FORCE_SAVE_PATTERNS = (
    r"(?i)\b(my name is|i'm called|call me)\b",
    r"(?i)\b(i prefer|i like|i love|i hate|i dislike|i use|i'm using)\b",
    r"(?i)\b(my secret|my password|my phrase|my key)\b",
    r"(?i)\b(i work on|i'm working on|my project)\b",
    r"(?i)\b(remember this|don't forget|write this down|save this)\b",
    r"(?i)\b(my goal|my plan|i want to|i need to)\b",
)

# Rule-based extraction from turns.
EXTRACT_PREFERENCES = (
    r"(?i)I (?:prefer|like|love|enjoy|hate|dislike) (\w+(?: \w+){0,5})",
    r"(?i)my favorite (\w+(?: \w+){0,5}) is (\w+)",
    r"(?i)I use (\w+(?: \w+){0,5}) for",
)
EXTRACT_PROJECTS = (
    r"(?i)I(?:'m| am) (?:building|working on|creating|making) (\w+(?: \w+){0,5})",
    r"(?i)my (?:project|app|tool) (\w+(?: \w+){0,3})",
)

# Messages that need no research.
SMALL_TALK = (
    r"^(ok|okay|sure|yes|no|got it|thanks|thank you|done|continue|go ahead|please|yep|yeah|nope|cool|great|good|fine|right|correct|"
    r"agreed|hi|hello|hey|bye|goodbye|see you|what\??|hmm|oh|wow)[\s!.?]*$"
)
INFORMATION_PATTERNS = (
    r"\bwhat\b[\s']s?\s+(is|are)\b", r"\btell\s+me\s+about\b", r"\bexplain\b", r"\bdescribe\b",
    r"\bwho\b[\s']s?\s+(is|are)\b", r"\bdefine\b", r"\bmeaning\s+of\b",
)
ASSISTANT_PATTERNS = (r"\bopenai\b", r"\bai\s+(agent|tool|assistant|model)\b")
PASSIVE_PATTERNS = (
    r"\bmentioned\b.*\b(bug|error|issue)\b", r"\btalked?\s+about\b", r"\bheard\s+about\b", r"\bsaid\s+.*\b(bug|error|crash)\b",
)
# Research topics, first match wins: (pattern, group of the topic, kind).
_TOPIC = r"(\w[\w.-]{1,20}(?:\s+[\w.-]{1,15}){0,2})"
TOPIC_PATTERNS = (
    (r"(?i)\b(build\s+me|create\s+(?:a\s+|an\s+)?|make\s+(?:me\s+)?(?:a\s+|an\s+)?)\s*" + _TOPIC, 2, "build"),
    (r"(?i)\b(install|set\s+up|setup|configure)\s+(?:a\s+|an\s+|the\s+)?" + _TOPIC, 2, "build"),
    (r"(?i)\bhow\s+(?:do\s+i|to|can\s+i)\s+(\w[\w.-]{1,15}(?:\s+[\w.-]{1,15}){0,3})", 1, "howto"),
    (r"(?i)\b(fix|debug|resolve|solve|troubleshoot)\s+(?:the\s+|a\s+|this\s+)?" + _TOPIC, 2, "fix"),
    (r"(?i)\b(?:error|exception|traceback|panic)\s*(?::|-)\s*[\"']?" + _TOPIC, 1, "error"),
    (r"(?i)\b(?:error|errno|exit\s+code)\s+([\w#]{2,15})", 1, "error"),
)

# Compression.
FILLERS = r"(?i)\b(basically|actually|honestly|literally|just|really|very|quite)\b"
COMPRESS_STOPWORDS = (
    "the|this|that|with|from|have|been|will|would|could|should|about|which|their|there|other|some|than|into|also|just|more|most|only|"
    "very|when|what|your|they|were|being|does|done|made|many|much|such|then|them|these|those|each|over|after|before|between|both|"
    "under|again|further|once|here|where|why|how|all|any|few|too"
)

# Words that are no keywords.
KEYWORD_STOPWORDS = (
    "a an the is are was were be been being have has had do does did will would could should may might shall can need dare ought "
    "used to of in for on with at by from as into through during before after above below between out off over under again further "
    "then once here there when where why how all each every both few more most other some such no nor not only own same so than too "
    "very just because but and or if while about up what which who whom this that these those i me my we our you your he him his she "
    "her it its they them their"
)

# Pages and addresses.
BINARY_SUFFIX = (
    r"\.(pdf|png|jpg|jpeg|gif|svg|webp|ico|zip|tar|gz|bz2|7z|exe|dmg|mp3|mp4|avi|mov|wav|ogg|flac|doc|docx|xls|xlsx|ppt|pptx|apk|iso|bin|dat)$"
)
PRIVATE_HOST = r"(?i)^127\.|^10\.|^172\.(1[6-9]|2\d|3[01])\.|^192\.168\.|^169\.254\.|^0\.|^::1|^fe80:|^fc00:"
DROPPED_BLOCKS = ("script", "style", "nav", "header", "footer", "aside", "form", "noscript")
# Types by rank for a summary of several memories.
TYPE_PRIORITY = (
    "profile", "preference", "setup", "project", "goal", "pattern", "entity", "learning", "issue", "fact", "event", "request",
)
# What session notes look for.
TECHNOLOGIES = ("python", "node", "rust", "react", "docker", "sqlite", "express")
NOTED_PLATFORMS = (
    (r"wsl|ubuntu|linux", "- Working in WSL/Linux environment confirmed"),
    (r"windows|native|powershell", "- Working in Windows environment"),
    (r"wsl.*windows|windows.*wsl", "- Cross-platform: WSL + Windows both referenced"),
)
NOTES_FRAME = ("CRITICAL_CONTEXT:\n", "\n\nKEY_FACTS:\n", "\n\nADVICE: Continue based on the preserved context above.")
NO_NOTES = "CRITICAL_CONTEXT: No critical context detected.\nADVICE: Proceed normally."
NOTED_PROJECT = r"(?:building|working on|creating) (\w[\w\s-]{1,30}?)(?:\.|,|!|$)"

# What makes a pair of similar statements one of preferences.
PAIR_PREFERENCES = r"prefer|like|love|hate|dislike|favorite|use |using "
