"""Texts, names and constants that decide results and must not drift."""

# --- fixed values: tasks, letters, conditions -------------------------------------------

TASKS = ("ACR", "CTR", "CLE", "CLH", "SIE", "SIH")
CHOICE_TASKS = ("CTR", "CLE", "CLH", "SIE", "SIH")
OPTION_COUNT = {"CTR": 3, "CLE": 4, "CLH": 4, "SIE": 4, "SIH": 4}
LETTERS = ("A", "B", "C", "D")
CONDITIONS = ("plain", "summary")
MODES = ("easy", "hard")
TASK_OF_MODE = {
    ("location", "easy"): "CLE",
    ("location", "hard"): "CLH",
    ("solution", "easy"): "SIE",
    ("solution", "hard"): "SIH",
}

# --- fixed values: constants --------------------------------------------------------------

UNSEEN_LOGPROB = -9999.0
FALLBACK_LOGPROB = 0.0
SUMMARY_ERROR_PREFIX = "ERROR: "
DEFAULT_LABEL = "code"
GENERATE_OPTIONS = {"temperature": 0.0, "max_tokens": 512, "stop": ["[/code]"]}
CHOICE_OPTIONS = {"temperature": 0.0, "max_tokens": 32}
SUMMARY_OPTIONS = {"temperature": 0.2}

CHANGE_PHRASES = {
    "add_only": "only add new lines of code",
    "remove_only": "only delete existing lines of code",
    "modify": "modify the code",
}

# --- fixed values: prompt texts -----------------------------------------------------------
# One text per task. SUMMARY_SECTION stands at {summary_section} under the "summary"
# condition and nothing stands there under "plain".

SUMMARY_SECTION = """[SUMMARY]
{summary}
[/SUMMARY]
"""

REFINE_PROMPT = """
### The following {lang} code snippet has received a code review.
[{lang}]
{code_snippet}
[/{lang}]
[CODE REVIEW]
{code_review}
[/CODE REVIEW]
{summary_section}### Please generate a revised version of the code snippet according to the code review. Do not add explanations.
[{lang}]
"""

CHANGE_TYPE_PROMPT = """
### The following is a multiple choice question (with answers) that tests code review comprehension. 
Question: Given this {lang} code snippet, what type of change is the code review asking for?
[{lang}]
{code_snippet}
[/{lang}]
[CODE REVIEW]
{code_review}
[/CODE REVIEW]
{summary_section}### Possible answers:
A. {option_a}
B. {option_b}
C. {option_c}
### Answer with the letter symbol only. Answer:
"""

LOCATION_PROMPT = """
### The following is a multiple choice question (with answers) that tests code review comprehension. 
Question: Given this {lang} code snippet, which line numbers is the code review asking to {ct}?
[{lang}]
{code_snippet}
[/{lang}]
[CODE REVIEW]
{code_review}
[/CODE REVIEW]
{summary_section}### Possible answers:
A. line numbers {option_a}
B. line numbers {option_b}
C. line numbers {option_c}
D. line numbers {option_d}
### Answer with the letter symbol only. Answer:
"""

SOLUTION_PROMPT = """
### The following is a multiple choice question (with answers) that tests code review comprehension. 
Question: Given this {lang} code snippet, which code revision is the code review asking for?
[{lang}]
{code_snippet}
[/{lang}]
[CODE REVIEW]
{code_review}
[/CODE REVIEW]
{summary_section}### Possible answers:
A. {option_a}
B. {option_b}
C. {option_c}
D. {option_d}
### Answer with the letter symbol only. Answer:
"""

SUMMARY_REQUEST = """   
You are a software engineering assistant.

Generate a concise pull request summary based on the code changes and review.

Old code:
{old_code}

New code:
{new_code}

Review:
{review}

Write only the pull request summary.
"""
