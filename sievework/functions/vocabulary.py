"""They must equal what users already rely on for results to be the same."""

#: Share of a criterion's weight that each level of a finding earns.
LEVEL_FACTORS = {"supported": 1.0, "partial": 0.5, "not_demonstrated": 0.0}

#: Stages of a record, in the order that they are reported.
STAGES = ("pending", "completed", "review", "duplicate", "failed")

#: Score bands: label, from, below.
SCORE_BANDS = (("0–19", 0, 20), ("20–39", 20, 40), ("40–59", 40, 60), ("60–79", 60, 80), ("80–100", 80, 101))

#: Section titles that count as headings, in lower case.
SECTION_TITLES = (
    "summary", "professional summary", "profile", "objective", "career objective",
    "about", "about me", "personal statement",
    "experience", "work experience", "professional experience", "employment",
    "employment history", "work history", "career history", "relevant experience",
    "education", "academic background", "qualifications", "academic qualifications",
    "skills", "technical skills", "core skills", "key skills", "core competencies",
    "competencies", "technical competencies", "skills summary",
    "projects", "personal projects", "selected projects", "key projects", "project experience",
    "certifications", "certificates", "licenses", "licences", "accreditations",
    "publications", "awards", "honors", "honours", "achievements", "accomplishments",
    "languages", "interests", "hobbies", "volunteering", "volunteer experience",
    "references", "contact", "contact details", "personal details", "additional information",
)

#: Words of a question that are never search terms.
QUESTION_STOP_WORDS = (
    "who which candidates candidate applicants applicant applications application have has with experience evidence of in and or the a an is are show me all for role "
    "skills knows know compare why ranked rank score scores top second first third list please show tell find this that these those two three completed review queued "
    "duplicate removed failed needs pending supported partially partial not demonstrated"
).split()

#: Words that do not occur in a person's name.
NAME_STOP_WORDS = (
    "i", "am", "a", "an", "the", "this", "that", "my", "only", "job", "skill",
    "to", "and", "or", "of", "for", "with", "built", "worked", "years",
    "not", "provided", "unknown", "anonymous",
)
WITHHELD_NAMES = ("not provided", "unknown", "anonymous")

#: Patterns of names, whole as they must match: a label with its value, a label alone, what is no name, where a name
#: ends, and what is left out of a file's name.
NAME_LABEL = r"^\s*(?:full\s+name|candidate(?:\s+name)?|applicant(?:\s+name)?|name)\s*[:\-–—]\s*(.*?)\s*$"
NAME_LABEL_ALONE = r"^\s*(?:full\s+name|candidate(?:\s+name)?|applicant(?:\s+name)?|name)\s*[:\-–—]?\s*$"
NAME_FIELD = r"^(?:name|candidate|applicant)\s*:"
NAME_NOISE = r"\b(?:resume|curriculum\s+vitae|curriculum|vitae|cv|profile|email|e-mail|phone|tel|mobile|linkedin|github|personal\s+details|contact\s+details|skills|experience|education|summary)\b"
NAME_END = r"\s+(?:email|e-mail|phone|tel|mobile|linkedin|github)\s*[:|\-]?\s*"
TITLE_START = r"\s+[|•·–—-]\s+"
FILE_NOISE = r"\b(?:resume|curriculum\s+vitae|cv|cover\s+letter)\b"
FILE_NUMBER = r"^\s*[A-Za-z]*\d[\w-]*\s*[-–—]\s*"

EMAIL = r"[\w.+-]+@[\w.-]+\.[A-Za-z]{2,}"
PHONE = r"(?<!\w)(?:\+?\d[\d ()/.\-]{6,}\d)(?!\w)"

#: Sizes of passages, in code points.
MAX_CHARS, TARGET_CHARS, MIN_CHARS, SECTION_BUDGET, SIMILAR = 1600, 1200, 200, 160, 0.6
STRATEGY_LABELS = {"fixed": "fixed-v1", "structure": "structure-v1", "hybrid": "hybrid-v1"}

#: Columns of the four report sheets.
RANKED_SHEET = ("Rank", "Tie", "Application ID", "Candidate name", "Score", "Matched skills", "Relevant evidence / projects", "Strengths", "Requirements not demonstrated", "Assessment status", "Processed date", "CV link")
EVIDENCE_SHEET = ("Application ID", "Criterion", "Weight", "Awarded points", "Explanation", "Cited CV text", "Source location")
REVIEW_SHEET = ("Application ID", "Filename", "Status", "Reason", "CV link")
LOG_SHEET = ("File ID", "Application ID", "Content version", "Rubric version", "Model", "Job state", "Step", "Retries", "Updated UTC", "Error time UTC", "Error type", "Report revision")
