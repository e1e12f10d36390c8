"""Vocabularies and ordered rule tables.

Every operator takes these as parameters; the module-level values are only the
defaults. Rule tables are lists of pairs, never dicts keyed by label, because
"first match wins" is the semantics of every chain built from them.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from pathlib import Path

_CONFIG = Path(__file__).parent / "config" / "skills.json"


@dataclass(frozen=True)
class Vocab:
    skills: tuple[str, ...]
    categories: tuple[tuple[str, tuple[str, ...]], ...]
    aliases: tuple[tuple[str, str], ...]
    normalization: tuple[tuple[str, str], ...]
    skills_to_track: tuple[str, ...]
    tech_skills: tuple[str, ...]

    def known_skills(self) -> list[str]:
        """Every skill named anywhere in the config, lower-cased, distinct, sorted."""
        names = set(s.lower() for s in self.skills)
        names |= set(s.lower() for s in self.skills_to_track)
        names |= set(s.lower() for s in self.tech_skills)
        for _, members in self.categories:
            names |= set(s.lower() for s in members)
        return sorted(names)


def load_vocab(path: str | Path | None = None) -> Vocab:
    with open(path or _CONFIG, encoding="utf-8") as f:
        raw = json.load(f)
    return Vocab(
        skills=tuple(raw["skills_dictionary"]),
        categories=tuple((k, tuple(v)) for k, v in raw["skill_categories"].items()),
        aliases=tuple(raw["skill_aliases"].items()),
        normalization=tuple(raw["skill_normalization"].items()),
        skills_to_track=tuple(raw.get("skills_to_track", [])),
        tech_skills=tuple(raw.get("tech_skills", [])),
    )


VOCAB = load_vocab()

# ---------------------------------------------------------------------------
# Fixed values. Everything below must equal the reference's tables for the
# same results. Stated in their natural order; first match wins in each list.
# ---------------------------------------------------------------------------

# Title standardisation (regex on lower-cased, stripped title -> label).
TITLE_RULES = [
    (r"data\s*analyst", "Data Analyst"),
    (r"data\s*scien", "Data Scientist"),
    (r"data\s*engineer", "Data Engineer"),
    (r"machine\s*learning|ml\s*engineer|mlops|ai\s*engineer", "ML Engineer"),
    (r"analytics\s*engineer|bi\s*engineer", "Analytics Engineer"),
    (r"software\s*(?:engineer|developer)|\bsde\b|programmer", "Software Engineer"),
    (r"backend\s*(?:engineer|developer)|server\s*developer", "Backend Engineer"),
    (r"frontend\s*(?:engineer|developer)|ui\s*developer", "Frontend Engineer"),
    (r"fullstack|full\s*stack", "Full Stack Engineer"),
    (r"devops|site\s*reliability|\bsre\b|platform\s*engineer|infrastructure\s*engineer", "DevOps Engineer"),
    (r"engineering\s*manager|tech\s*lead|technical\s*lead", "Engineering Manager"),
    (r"product\s*manager|product\s*owner", "Product Manager"),
    (r"project\s*manager|program\s*manager|delivery\s*manager", "Project Manager"),
    (r"business\s*analyst|systems\s*analyst", "Business Analyst"),
    (r"financial?\s*analyst", "Financial Analyst"),
    (r"marketing\s*analyst|digital\s*analyst", "Marketing Analyst"),
]

# City aliases (lower-cased city -> canonical city).
CITY_ALIASES = [
    ("nyc", "New York"),
    ("new york city", "New York"),
    ("ny", "New York"),
    ("sf", "San Francisco"),
    ("san fran", "San Francisco"),
    ("la", "Los Angeles"),
    ("l.a.", "Los Angeles"),
    ("dc", "Washington"),
    ("washington dc", "Washington"),
    ("washington d.c.", "Washington"),
]

# State names -> abbreviation (only reachable with state_map=True).
STATE_NAMES = [
    ("california", "CA"), ("new york", "NY"), ("texas", "TX"), ("washington", "WA"),
    ("massachusetts", "MA"), ("illinois", "IL"), ("colorado", "CO"), ("georgia", "GA"),
    ("florida", "FL"), ("virginia", "VA"), ("north carolina", "NC"), ("pennsylvania", "PA"),
    ("ohio", "OH"), ("michigan", "MI"), ("arizona", "AZ"), ("oregon", "OR"),
    ("minnesota", "MN"), ("maryland", "MD"), ("tennessee", "TN"), ("indiana", "IN"),
]

# Role category from the standardised title (substring tests, first match).
ROLE_RULES = [
    (("data scientist", "machine learning", "ai"), "Data Science & ML"),
    (("data analyst", "bi analyst", "business analyst"), "Analytics"),
    (("data engineer",), "Data Engineering"),
    (("software", "developer"), "Software Engineering"),
    (("devops", "sre", "platform", "cloud"), "DevOps & Cloud"),
    (("manager",), "Management"),
    (("architect",), "Architecture"),
    (("security", "qa"), "Security & QA"),
]
ROLE_DEFAULT = "Other"

# Salary heuristics (lakhs per annum). Canonical role table in table order.
SALARY_BASE = [
    ("data scientist", 12, 25),
    ("senior data scientist", 20, 35),
    ("machine learning engineer", 15, 30),
    ("data engineer", 10, 22),
    ("data analyst", 6, 15),
    ("software engineer", 8, 20),
    ("senior software engineer", 16, 30),
    ("backend developer", 8, 18),
    ("full stack developer", 8, 20),
    ("devops engineer", 10, 22),
    ("product manager", 12, 28),
    ("business analyst", 6, 16),
]
# Broad fallbacks after the table: all listed substrings must occur.
SALARY_ROLE_FALLBACKS = [
    (("data", "scien"), "data scientist"),
    (("data", "analy"), "data analyst"),
    (("data", "eng"), "data engineer"),
    (("ml",), "machine learning engineer"),
    (("machine",), "machine learning engineer"),
    (("backend",), "backend developer"),
    (("full", "stack"), "full stack developer"),
    (("devops",), "devops engineer"),
    (("product", "manag"), "product manager"),
    (("business", "analy"), "business analyst"),
    (("senior",), "senior software engineer"),
    (("sr",), "senior software engineer"),
    (("software",), "software engineer"),
    (("swe",), "software engineer"),
]
SALARY_ROLE_DEFAULT = "software engineer"

LOCATION_MULTIPLIERS = [
    ("bangalore", 1.15), ("bengaluru", 1.15), ("mumbai", 1.10), ("hyderabad", 1.05),
    ("delhi", 1.05), ("delhi ncr", 1.05), ("gurgaon", 1.10), ("noida", 1.00),
    ("pune", 1.00), ("chennai", 0.95), ("kolkata", 0.90),
]
COMPANY_SIZE_MULTIPLIERS = [
    ("Enterprise", 1.15), ("Large", 1.05), ("Medium", 0.95), ("Small", 0.85), ("Startup", 0.80),
]
PREMIUM_SKILLS = [
    "machine learning", "deep learning", "ai", "kubernetes", "aws",
    "azure", "gcp", "spark", "tensorflow", "pytorch", "docker",
    "kafka", "airflow", "snowflake", "databricks", "mlops",
]
# Experience level from title keywords: level 4 > 3 > 1, default 2.
EXPERIENCE_LEVEL_KEYWORDS = [
    (4, ("head", "director", "vp", "chief", "principal")),
    (3, ("senior", "sr.", "sr ", "lead", "staff")),
    (1, ("junior", "jr.", "jr ", "intern", "trainee", "fresher")),
]
EXPERIENCE_LEVEL_DEFAULT = 2
EXPERIENCE_MULTIPLIERS = [(1, 0.75), (2, 1.0), (3, 1.3), (4, 1.6)]
SKILL_PREMIUM_PER_SKILL = 0.03

# Experience classes in descriptions (regex on lower-cased text, first match).
EXPERIENCE_PATTERNS = [
    ("Entry Level (0-2 yrs)", r"\b(?:0|1|2)\+?\s*(?:years?|yrs?)|fresher|entry\s*level|junior"),
    ("Mid Level (3-5 yrs)", r"\b(?:3|4|5)\+?\s*(?:years?|yrs?)|mid\s*level"),
    ("Senior (6-10 yrs)", r"\b(?:6|7|8|9|10)\+?\s*(?:years?|yrs?)|senior|lead"),
    ("Expert (10+ yrs)", r"\b(?:1[0-9]|[2-9][0-9])\+?\s*(?:years?|yrs?)|principal|architect|director"),
]

# Job types in descriptions (regex, multi-label).
JOB_TYPE_PATTERNS = [
    ("Full-time", r"full\s*-?\s*time"),
    ("Part-time", r"part\s*-?\s*time"),
    ("Contract", r"contract|freelance"),
    ("Remote", r"remote|work\s*from\s*home|wfh"),
    ("Hybrid", r"hybrid"),
    ("On-site", r"on\s*-?\s*site|office"),
]

# Salary mentions in free text (case-insensitive).
SALARY_TEXT_PATTERN = (
    r"(?:₹|INR|Rs\.?|USD|\$)\s*[\d,]+(?:\s*-\s*[\d,]+)?"
    r"(?:\s*(?:LPA|lakh|K|k|per\s*(?:month|annum|year)))?"
)
# Lakhs per annum: the number next to the unit.
LPA_PATTERN = r"(\d+(?:\.\d+)?)\s*(?:lpa|lakh|lac)"

# Market role categories on titles (substring, first match; unmatched dropped).
MARKET_ROLE_CATEGORIES = [
    ("Software Engineer", ("software engineer", "software developer", "sde", "swe")),
    ("Data Scientist", ("data scientist", "data analyst", "data engineer")),
    ("DevOps", ("devops", "sre", "platform engineer", "infrastructure")),
    ("Frontend", ("frontend", "front-end", "ui developer", "react", "angular")),
    ("Backend", ("backend", "back-end", "api developer")),
    ("Full Stack", ("full stack", "fullstack")),
    ("Machine Learning", ("machine learning", "ml engineer", "ai engineer")),
    ("Product", ("product manager", "product owner")),
    ("QA/Testing", ("qa", "test", "quality", "automation")),
]

# Experience demand keywords over description + ' ' + title (first match).
EXPERIENCE_DEMAND_KEYWORDS = [
    ("Entry Level (0-2 yrs)", ("fresher", "entry", "0-2", "1-2", "junior")),
    ("Mid Level (3-5 yrs)", ("3-5", "2-4", "mid level", "intermediate")),
    ("Senior (6-10 yrs)", ("senior", "5-8", "6-10", "lead")),
    ("Expert (10+ yrs)", ("10+", "principal", "architect", "director")),
]

# Resume parsing.
RESUME_FRESHER_PATTERN = r"\b(?:fresher|fresh graduate|entry[- ]level)\b"
RESUME_EXPERIENCE_PATTERNS = [
    r"(\d{1,2})\+?\s*(?:years?|yrs?)[\s\w]*(?:of\s+)?(?:experience|exp)",
    r"experience[\s:]*(\d{1,2})\+?\s*(?:years?|yrs?)",
    r"(\d{1,2})\+?\s*(?:years?|yrs?)\s+(?:in|of|working)",
    r"worked\s+(?:for\s+)?(\d{1,2})\+?\s*(?:years?|yrs?)",
]
RESUME_GRADUATION_PATTERNS = [
    r"(?:graduated?|batch|class\s+of|passing\s+year)[:\s]*(20\d{2})",
    r"(20\d{2})[\s-]+(?:20\d{2})?[\s]*(?:b\.?\s*(?:tech|e|sc|eng|ca))",
    r"(?:b\.?\s*(?:tech|e|sc|eng|ca))[^\n]{0,30}(20\d{2})",
]
RESUME_TITLES = [
    "chief technology officer", "cto", "vp of engineering",
    "director of engineering", "engineering manager",
    "principal engineer", "staff engineer",
    "senior software engineer", "senior developer",
    "senior data scientist", "senior data engineer",
    "senior machine learning engineer", "senior ml engineer",
    "senior frontend engineer", "senior backend engineer",
    "senior full stack developer", "senior devops engineer",
    "software engineer", "software developer",
    "data scientist", "data analyst", "data engineer",
    "machine learning engineer", "ml engineer",
    "frontend engineer", "frontend developer",
    "backend engineer", "backend developer",
    "full stack developer", "full stack engineer",
    "devops engineer", "cloud engineer", "sre",
    "product manager", "project manager",
    "qa engineer", "test engineer",
    "business analyst", "solutions architect",
    "web developer", "mobile developer",
    "android developer", "ios developer",
    "python developer", "java developer",
    "data science intern", "software intern", "ml intern",
    "machine learning intern", "web development intern",
    "software engineering intern", "data analyst intern",
    "data engineering intern", "research intern",
    "aspiring data scientist", "aspiring data analyst",
    "aspiring software engineer", "aspiring ml engineer",
    "data science enthusiast", "ml enthusiast",
]
RESUME_OBJECTIVE_PATTERN = (
    r"(?:objective|career\s*(?:goal|objective|summary))[:\s]+[^.]*?"
    r"((?:data|software|ml|machine learning|web|full.?stack|backend|frontend|devops|cloud)"
    r"\s*(?:scientist|engineer|developer|analyst|intern))"
)
RESUME_SKILL_TITLES = [
    ("data science", "Data Science Professional"),
    ("machine learning", "ML / Data Science Professional"),
    ("deep learning", "ML / Data Science Professional"),
    ("data analysis", "Data Analyst"),
    ("web development", "Web Developer"),
    ("android", "Android Developer"),
    ("ios", "iOS Developer"),
    ("flutter", "Mobile Developer"),
    ("react", "Frontend Developer"),
    ("angular", "Frontend Developer"),
    ("node", "Backend Developer"),
    ("devops", "DevOps Engineer"),
    ("cloud", "Cloud Engineer"),
]
RESUME_CITIES = [
    "bangalore", "bengaluru", "mumbai", "delhi", "new delhi",
    "hyderabad", "pune", "chennai", "kolkata", "noida",
    "gurgaon", "gurugram", "ahmedabad", "jaipur", "lucknow",
    "chandigarh", "indore", "kochi", "thiruvananthapuram",
    "coimbatore", "nagpur", "visakhapatnam", "bhubaneswar",
]

# Certification suggestions: keyword contained in a missing skill, first keyword.
CERTIFICATIONS = [
    ("aws", "AWS Solutions Architect / AWS Developer Associate"),
    ("azure", "Microsoft Azure Fundamentals (AZ-900)"),
    ("gcp", "Google Cloud Professional Data Engineer"),
    ("python", "PCEP/PCAP Python Certification"),
    ("machine learning", "TensorFlow Developer Certificate / AWS ML Specialty"),
    ("docker", "Docker Certified Associate"),
    ("kubernetes", "Certified Kubernetes Administrator (CKA)"),
    ("data science", "IBM Data Science Professional Certificate"),
    ("sql", "Microsoft SQL Server Certification"),
    ("devops", "AWS DevOps Engineer / Azure DevOps Engineer"),
]

# City dimension for landed payloads (lookup key, city, state).
CITY_DIM = [
    ("bangalore", "Bangalore", "Karnataka"),
    ("mumbai", "Mumbai", "Maharashtra"),
    ("pune", "Pune", "Maharashtra"),
    ("hyderabad", "Hyderabad", "Telangana"),
    ("chennai", "Chennai", "Tamil Nadu"),
    ("delhi", "Delhi", "Delhi NCR"),
    ("noida", "Noida", "Uttar Pradesh"),
    ("gurgaon", "Gurgaon", "Haryana"),
    ("kolkata", "Kolkata", "West Bengal"),
    ("ahmedabad", "Ahmedabad", "Gujarat"),
]

# Sample alerts: (name, title_keywords, skills, location, company, min_salary_lpa, job_type).
SAMPLE_ALERTS = [
    ("Backend posts in Pune", ["backend", "developer", "engineer"], ["python", "docker", "java"], "pune", None, None, None),
    ("Analysts who may stay at home", ["analyst", "data"], ["sql", "excel"], None, None, None, "remote"),
    ("Leads from 30 lakh", ["lead", "senior", "director"], None, None, None, 30.0, None),
]

# Match score weights (skills, title, location, company, job type); sum is 100.
MATCH_WEIGHTS = (40.0, 25.0, 15.0, 10.0, 10.0)

# TF-IDF settings of the skill NLP step.
TFIDF_TOKEN_PATTERN = r"[a-zA-Z0-9#+.\-]+"
TFIDF_MAX_FEATURES = 200
TFIDF_MIN_DF = 2
TFIDF_MAX_DF = 0.95
CLUSTER_THRESHOLD = 0.3
