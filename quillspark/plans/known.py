"""A small corpus whose answers are known: twelve clauses and a question for each."""

PASSAGES = [
    ("p01", "Either side may end this agreement with thirty days written notice to the other."),
    ("p02", "Invoices fall due within forty-five days; late sums bear interest at two percent a month."),
    ("p03", "The supplier indemnifies the customer against claims that the product infringes a patent."),
    ("p04", "Liability for indirect damage is excluded and total liability is capped at fees paid in a year."),
    ("p05", "Confidential material stays secret for five years after disclosure."),
    ("p06", "Disputes go to arbitration in Geneva under the rules of the chamber of commerce."),
    ("p07", "The tenant pays the deposit before moving in and gets it back within a month of leaving."),
    ("p08", "Personal data is processed only inside the union and erased on request."),
    ("p09", "The warranty covers defects of material and workmanship for twenty-four months."),
    ("p10", "An employee receives twenty-five days of paid holiday each calendar year."),
    ("p11", "Floods, strikes and war excuse delay for as long as they last."),
    ("p12", "All inventions made on company time belong to the company."),
]
QUESTIONS = [
    (1, "How many days notice end the agreement?", "p01"),
    (2, "What interest do late invoices bear?", "p02"),
    (3, "Who indemnifies against patent claims?", "p03"),
    (4, "Is liability capped for indirect damage?", "p04"),
    (5, "How long does confidential material stay secret?", "p05"),
    (6, "Where does arbitration of disputes take place?", "p06"),
    (7, "When does the tenant get the deposit back?", "p07"),
    (8, "Is personal data erased on request?", "p08"),
    (9, "How many months does the warranty cover defects?", "p09"),
    (10, "How much paid holiday does an employee receive?", "p10"),
    (11, "Do strikes excuse delay?", "p11"),
    (12, "Who owns inventions made on company time?", "p12"),
]


def values(rows: list[tuple], names: str) -> str:
    """The rows as a SQL table."""
    def lit(x) -> str:
        return str(x) if isinstance(x, (int, float)) else "'" + x.replace("'", "''") + "'"

    return "(values " + ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows) + f") as v({names})"
