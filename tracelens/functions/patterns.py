"""Word lists and patterns. Everything in this module is a fixed value that results depend on."""

from __future__ import annotations

# Single-word hedges used when no lexicon file is given.
HEDGE_WORDS = [
    "might", "could", "perhaps", "possibly", "probably", "likely",
    "unlikely", "suggest", "appear", "seem", "tend", "assume",
    "approximate", "roughly", "generally", "typically", "usually",
    "often", "sometimes", "occasionally", "rarely", "seldom",
]

# Regular expressions, matched case-insensitively and counted one by one.
ALTERNATIVES = [
    r"\bi could\b", r"\balternatively\b", r"\banother approach\b", r"\bone option\b",
    r"\bwe could also\b", r"\binstead of\b", r"\bor we could\b", r"\blet me try a different\b",
]
BACKTRACKS = [
    r"\bwait\b", r"\bactually\b", r"\bno,", r"\blet me reconsider\b", r"\bI was wrong\b",
    r"\bthat's not right\b", r"\bhmm\b", r"\bon second thought\b",
]
SELF_DIRECTIVE = [r"\bI need to\b", r"\blet me\b", r"\bI should\b", r"\bI will\b", r"\bI'll\b"]
METACOGNITIVE = [
    r"\bwait\b", r"\bactually\b", r"\bhmm\b", r"\bhold on\b", r"\bon second thought\b",
    r"\bI was wrong\b", r"\bthat's not right\b", r"\blet me reconsider\b", r"\bI see\b",
]
CAUSAL = [
    r"\bbecause\b", r"\bsince\b", r"\btherefore\b", r"\bdue to\b", r"\bthis means\b",
    r"\bwhich means\b", r"\bthe reason\b", r"\bcaused by\b", r"\bas a result\b",
]
CONTRAST = [r"\binstead\b", r"\brather than\b", r"\binstead of\b"]
WRONG_STUCK = [
    r"\bwrong\b", r"\bissue\b", r"\bbug\b", r"\bincorrect\b", r"\bnot working\b",
    r"\bdoesn't work\b", r"\bstill failing\b", r"\bbroken\b",
]
TIER2 = {
    "self_directive_density": SELF_DIRECTIVE,
    "metacognitive_density": METACOGNITIVE,
    "causal_density": CAUSAL,
    "instead_contrast_density": CONTRAST,
    "wrong_stuck_density": WRONG_STUCK,
}

# Substrings of the lowercased text.
SUBSTRINGS = {
    "metacognitive_density": ["actually", "wait", "hmm", "i see", "hold on"],
    "tentative_density": ["let me try", "maybe", "not sure", "perhaps"],
    "insight_density": ["i understand", "the issue is", "the problem is", "the bug is", "actually"],
    "instead_contrast_density": ["instead", "rather than", "instead of"],
    "self_directive_density": ["i need to", "let me", "i should", "i'll", "i have to"],
    "wrong_stuck_density": ["wrong", "incorrect", "mistake", "broken"],
    "causal_density": ["because", "since", "therefore", "due to"],
}

# One alternation per feature over the lowercased text.
ALTERNATIONS = {
    "metacognitive_density": r"\b(?:actually|wait|hmm|hold on|i see|oh right|ah)\b",
    "tentative_density": r"\b(?:let me try|maybe|not sure|perhaps|try another|might work)\b",
    "insight_density": r"\b(?:actually|i understand|the issue is|the problem is|the bug is|i see now|that explains)\b",
    "instead_contrast_density": r"\b(?:instead|rather than|instead of|but actually|no wait)\b",
    "self_directive_density": r"\b(?:i need to|i should|let me|i'll|i will|i have to|i must)\b",
    "wrong_stuck_density": r"\b(?:wrong|incorrect|mistake|broken|doesn't work|not working)\b",
    "causal_density": r"\b(?:because|since|therefore|due to|causes|caused by|so that)\b",
    "hedging_density": r"\b(?:might|may|could|possibly|probably|seems|appears|suggest)\b",
}

# Verification and planning language.
VERIFICATION_WORDS = ["verify", "check", "confirm", "test", "ensure", "validate", "assert"]
VERIFICATION_PHRASES = ["make sure"]
PLANNING_WORDS = ["first", "then", "next", "finally"]
PLANNING_PHRASES = ["let me", "now i", "now let"]

# Naming patterns, the strict and the loose reading.
NAMING = [r"`[^`]+`", r"\b[A-Z][a-z]+(?:[A-Z][a-z]+)+\b", r"\b[a-z]+(?:_[a-z]+){1,}\b", r"\b\w+\.\w{1,4}\b"]
NAMING_LOOSE = [r"`[^`]+`", r"\b[A-Z][a-z]+[A-Z][a-zA-Z]*\b", r"\b[a-z]+(?:_[a-z]+)+\b", r"[\w/]+\.\w{1,4}\b"]

# Patterns without word boundaries, as used for run-level ratios and hit rates.
CONTRAST_OPEN = r"however|but|instead|rather"
BACKTRACK_OPEN = r"actually|wait|instead"
TENTATIVE_KCHAR = [r"\blet me try\b", r"\bmaybe\b", r"\bnot sure\b", r"\bmight\b", r"\bperhaps\b"]
ACTUALLY_KCHAR = [r"\bactually\b"]

# Thinking-text patterns.
COMPAT_WORDS = r"compat|version|install|deprecated|removed|Python 3,\d"
ENVIRONMENT = (
    r"(?:pip|install|docker|virtualenv|venv|conda|setuptools|pkg_resources|collections\.Mapping|"
    r"compatibility|deprecated|removed in|can't compile|can't build|not available|"
    r"ImportError|ModuleNotFoundError)"
)
PIVOT = (
    r"(?:different approach|try (?:a )?(?:different|another)|instead,? (?:I'll|let me)|let me try|"
    r"a (?:simpler|better|different) (?:approach|way|method|strategy))"
)
CODE_STRUCTURE = r"\b(?:method|class|module|function|constructor|property|attribute)\b"
FUNC_REF = r"\b\w+\(\)"
DEAD_END = (
    r"(?:this (?:approach|method|strategy) (?:won't|doesn't|can't|isn't)|that (?:won't|doesn't) work|"
    r"I (?:can't|cannot) (?:find|get|make|run)|there(?:'s| is) no way to)"
)
FIX_MENTION = r"the fix|I need to fix"
SENTENCE_START = r"(?:^|\n|(?<=\.\s))"
ACTUALLY_START = SENTENCE_START + r"Actually\b"
INTERRUPT_START = SENTENCE_START + r"(?:Actually|Wait|Hmm|Oh|Ah)\b"
REDIAGNOSIS = r"the (?:issue|problem) is"
DASH = r"\w\s+[-–—]\s+\w"
FILE_REF = r"`[^`]*\.py`"
LINE_REF = r"\blines?\s+\d+"
BACKTICK_ID = r"`\w+`"
CODE_PATH = (
    r"(?:\w+\s*(?:→|->|=>|calls?|invokes?|delegates?\s+to)\s*\w+)|"
    r"(?:from\s+`\w+`\s+to\s+`\w+`)|(?:the\s+(?:flow|chain|sequence)\s+(?:is|goes))"
)
ERROR_QUOTE = r"`[^`]*(?:Error|error|Exception|Warning|warning|failed|invalid)[^`]*`"

# Phrase sets from the follow-up design notes.
EXTENDED = {
    "coding_uncertainty": [
        r"\bnot sure\b", r"\bmight not\b", r"\bmay not\b", r"\bnot certain\b", r"\bI think\b", r"\bpossibly\b",
        r"\bcould be\b", r"\bhard to tell\b", r"\bnot obvious\b", r"\bunclear\b", r"\btricky\b",
        r"\bcomplicated\b", r"\bconfusing\b", r"\bweird\b", r"\bstrange\b", r"\bunexpected\b",
    ],
    "confidence_assertion": [
        r"\bthe (?:issue|problem|bug|fix) is\b",
        r"\bI (?:will|need to|should)\s+(?:add|remove|change|fix|update|modify)\b",
        r"\bthis (?:fixes|resolves|addresses)\b", r"\bthe (?:correct|right|proper) (?:way|approach|fix)\b",
        r"\bspecifically\b", r"\bexactly\b", r"\bprecisely\b",
    ],
    "vague_action": [
        r"\blet me (?:check|look|see|try|examine|investigate)\b", r"\bnow (?:let me|I (?:will|need to|should))\b",
        r"\bI'll (?:start|begin) by\b", r"\bfirst,? (?:let me|I (?:will|need to|should))\b",
    ],
    "diagnosis_specificity": [
        r"`[^`]+`", r"line\s+\d+", r"\b(?:def|class|function|method)\s+\w+", r"\w+\.py", r"\w+/\w+",
    ],
    "negative_evaluation": [
        r"\bwrong\b", r"\bbroken\b", r"\bfailing\b", r"\bdoesn't work\b", r"\bnot working\b",
        r"\berror\b", r"\bbug\b", r"\bissue\b", r"\bproblem\b",
    ],
    "positive_evaluation": [
        r"\bworks\b", r"\bcorrect\b", r"\bfixed\b", r"\bsolved\b", r"\bsuccess\b", r"\bpasses\b",
        r"\bclean\b", r"\bgood\b", r"\bproperly\b",
    ],
}
CORRECTIONS = BACKTRACKS

# Test commands.
TEST_REGEX = r"pytest\b|python.*-m\s+pytest|unittest|test_|_test\.py"
TEST_SUBSTRINGS = ["pytest", "test", "unittest", "nosetests"]
TEST_RUNNERS = ["pytest", "unittest", "runtests", "manage.py test", "tox", "nox"]

# Tool names and shell words of the state-modifying classification.
WRITE_TOOLS = ["Write", "Edit"]
READ_TOOLS = ["Read", "Grep", "Glob", "Search", "Skill", "ToolSearch", "WebSearch", "WebFetch"]
READ_COMMANDS = [
    "ls", "cat", "head", "tail", "wc", "file", "stat", "du", "df",
    "tree", "less", "more", "readlink", "realpath", "md5sum", "sha256sum", "shasum",
    "grep", "rg", "awk", "sort", "uniq", "cut", "tr", "diff", "comm", "paste", "column", "jq",
    "echo", "printf", "pwd", "which", "type", "env", "printenv",
    "whoami", "hostname", "uname", "id", "date", "uptime", "true", "false", "test", "[",
    "ps", "top", "htop", "pgrep", "lsof",
]
READ_PREFIXES = [
    "git log", "git diff", "git status", "git branch", "git show", "git blame", "git stash list",
    "git tag", "git remote", "git rev-parse", "git describe", "git shortlog", "git reflog",
    "git ls-files", "git ls-tree", "git cat-file", "git fetch",
]
ONE_LINERS = ["python3 -c", "python -c", "node -e"]
ONE_LINER_WRITES = [
    "open(", "subprocess", "os.system", "os.popen", "shutil", "pathlib", ".write(", ".mkdir(", ".rename(",
    "os.remove", "os.unlink", "os.makedirs", "import os", "from os", "exec(", "eval(",
    "fs.", "child_process", "execSync", "writeFile",
]
PIPE_WRITERS = ["tee", "xargs", "dd", "patch", "install"]
FIND_ACTIONS = ["-delete", "-exec rm", "-exec mv", "-execdir rm", "-execdir mv"]

# Expected sign of each run feature's association with success.
DIRECTIONS = {
    "recovery_rate": "positive",
    "fail_then_switch_rate": "positive",
    "first_edit_position": "positive",
    "unique_files_touched": "negative",
    "edit_churn_rate": "negative",
    "test_run_count": "positive",
    "precision_naming_score": "positive",
    "self_directive_density": "negative",
    "metacognitive_density": "positive",
    "causal_density": "positive",
    "instead_contrast_density": "positive",
    "wrong_stuck_density": "negative",
    "reasoning_to_action_alignment": "positive",
    "random_noise": "null",
    "total_state_modifying_calls": "negative",
}

# Gate conditions (code, timing, source).
CONDITIONS = [
    ("C0", "none", "none"),
    ("A1", "early", "introspective"),
    ("A2", "early", "extrospective"),
    ("A3", "early", "both"),
    ("B1", "always", "introspective"),
    ("B2", "always", "extrospective"),
    ("B3", "always", "both"),
    ("P1", "none", "none"),
    ("P2", "none", "none"),
]
DEFAULT_TOKEN_THRESHOLD = 29
DEFAULT_CHAR_THRESHOLD = 117
