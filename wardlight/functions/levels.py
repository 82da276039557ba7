"""Severities in order, and tactics as an attack goes through them."""

SEVERITIES = ("low", "medium", "high", "critical")
TACTICS = (
    "Reconnaissance", "Initial Access", "Execution", "Persistence", "Privilege Escalation", "Defense Evasion", "Credential Access",
    "Discovery", "Lateral Movement", "Collection", "Command and Control", "Exfiltration", "Impact",
)
