"""Fixed values that results depend on."""

# Risk categories: title and pattern over lower-cased page text, in order.
RISKS = [
    ("Cybersecurity & Information Security", r"(cybersecurity|data\s+security|information\s+security)"),
    ("Regulatory & Legal Compliance", r"(regulatory\s+compliance|litigation|statutory\s+changes|compliance\s+risk)"),
    ("Foreign Exchange & Currency Volatility", r"(foreign\s+exchange|currency\s+volatility|forex)"),
    ("Talent Retention & Human Capital", r"(talent\s+attrition|human\s+capital|key\s+personnel|wage\s+inflation)"),
    ("Macroeconomic & Geopolitical Uncertainty", r"(geopolitical|macroeconomic|inflationary\s+pressures|global\s+slowdown)"),
    ("Climate Change & ESG Governance", r"(climate\s+change|esg|environmental\s+sustainability)"),
    ("Supply Chain & Third-Party Reliance", r"(supply\s+chain|vendor\s+concentration|logistics)"),
    ("Technological Disruption & AI Adoption", r"(technological\s+obsolescence|ai\s+disruption|disruptive\s+technology)"),
]
DEFAULT_RISK = "Operational & Market Volatility"
DEFAULT_RISK_TEXT = "Standard operational, macroeconomic, and competitive uncertainties disclosed in {} annual filing."

# Guidance categories: title and pattern over lower-cased sentences, first match counts.
GUIDANCE = [
    ("CapEx & Capital Allocation", r"(capex|capital\s+expenditure|investment\s+of|outlay|investing\s+around|spend\s+around)"),
    ("Revenue & Margin Guidance", r"(growth\s+guidance|margin\s+target|expect\s+to\s+grow|target\s+of|guidance\s+for|revenue\s+target)"),
    ("Capacity & Project Commissioning", r"(commissioning|operationalize|expansion\s+phase|new\s+facility|pipeline|commercial\s+operation)"),
    ("Debt & Liquidity Strategy", r"(debt\s+reduction|leverage|cash\s+flow|liquidity|refinanc|borrowing)"),
    ("Strategic Order Book & Clients", r"(order\s+book|deal\s+win|new\s+client|contract\s+value|backlog)"),
]

# Words of a question that select a section of the answer.
INTENTS = {
    "performance": ["revenue", "growth", "profit", "margin", "eps", "performance"],
    "risk": ["risk", "threat", "concern", "disclos"],
    "guidance": ["concall", "guidance", "capex", "capital", "management", "outlook", "plan", "commentary"],
}

# Node colours and sizes.
COLORS = {"company": "#f59e0b", "metric": "#10b981", "risk": "#f43f5e", "document": "#06b6d4", "guidance": "#a855f7"}
SIZES = {"company": 28, "document": 22, "metric": 18, "guidance": 18, "risk": 17}

STATUSES = ["pending", "downloading", "extracting", "structuring", "storing", "processed", "failed"]
LOG_STATUSES = ["started", "success", "warning", "failed"]

# Sentences put into test texts so that the patterns above meet something: one for each risk, then each guidance category.
SEEDS = [
    "The board reviews cybersecurity controls and incident response plans every quarter.",
    "Pending litigation in two jurisdictions may lead to material claims against the group.",
    "Movements in foreign exchange rates affect the reported value of overseas earnings.",
    "Higher talent attrition in engineering roles could delay several customer programmes.",
    "A geopolitical conflict near shipping lanes may reduce demand in export markets.",
    "Physical effects of climate change could interrupt operations at coastal plants.",
    "Dependence on one supply chain partner exposes the group to shortages of parts.",
    "An abrupt shift to disruptive technology may shorten the life of installed products.",
    "We plan capital expenditure of about four hundred crore over the next two years.",
    "Our growth guidance for the coming year remains in the low double digits overall.",
    "Commissioning of the second line is expected before the end of the third quarter.",
    "We aim for further debt reduction from internal accruals during the current year.",
    "The order book stands at a record level and covers nearly six quarters of sales.",
]
