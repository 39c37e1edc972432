"""Rule packs that come with the library."""

from __future__ import annotations

# Patterns of personal data, and what replaces them.
PII = [
    ("email", r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}", "EMAIL", True),
    ("ssn", r"\b\d{3}-\d{2}-\d{4}\b", "SSN", True),
    ("credit-card", r"\b\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4}\b", "CARD", True),
    ("phone", r"\b(?:\+?1[-. ]?)?\(?\d{3}\)?[-. ]\d{3}[-. ]\d{4}\b", "PHONE", True),
    ("mac-address", r"\b(?:[0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}\b", "MAC", True),
    ("ipv4", r"\b(?:\d{1,3}\.){3}\d{1,3}\b", "IP", False),
]
# Phrases of crash and power events.
CRASH = "Faulting application name:|stopped interacting with Windows|Fault bucket|unhandled exception|Application Hang|Application Error"
POWER = "The Event log service was started|The Event log service was stopped|The previous system shutdown at|The system uptime is|rebooted without cleanly shutting down|The operating system started at|The operating system is shutting down|Kernel-Power|Kernel-Boot"


def _pack(name: str, purpose: str, rules: list[dict]) -> dict:
    return {"schemaVersion": "2.0", "title": name, "sections": [{"name": name, "purpose": purpose, "providers": ["*"], "rules": rules}]}


def _rule(name: str, match: str, action: dict, on: bool = True, **more) -> dict:
    return {"name": name, "match": match, "enabled": on, "action": action} | more


def _field(name: str, match: str, pattern: str, strip: bool, **targets) -> dict:
    return _rule(name, match, {"type": "extract", "pattern": pattern, "set": targets, "strip": strip}, field="message")


def _participant(key: str, name: str) -> dict:
    return {"id": key, "displayName": name, "type": "participant"}


def _element(name: str, match: str, regex: bool, kind: str, source: str, to: str = "", text: str = "", **more) -> dict:
    """A rule of a diagram."""
    return {"name": name, "match": match, "useRegex": regex, "enabled": True, "action": {"type": kind, "from": source, "to": to, "text": text} | more}


PII_FILTER = _pack("PiiFilter", "filter", [_rule(f"exclude-{n}", p, {"type": "exclude"}, on) for n, p, _, on in PII])
PII_REDACT = _pack("PiiRedact", "filter", [_rule(f"redact-{n}", p, {"type": "redact", "replacement": f"[REDACTED-{mark}]"}, on) for n, p, mark, on in PII])
NOISE_FILTER = _pack("NoiseFilter", "filter", [_rule("exclude-debug", "DEBUG|TRACE|VERBOSE", {"type": "exclude"}, unmatch="ERROR|CRITICAL|FATAL")])
CRASH_FILTER = _pack("CrashFilter", "filter", [_rule("keep-app-crashes", CRASH, {"type": "include"})])
POWER_FILTER = _pack("PowerFilter", "filter", [_rule("keep-power-events", POWER, {"type": "include"})])
# Shapes of servicing, setup and update log lines, in the packs from here on.
DISM_FIELDS = _pack(
    "DismFields", "enrichment",
    [
        _field("dism-line", r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}", r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}(\.\d+)?", True, Source="DISM"),
        _field("dism-component", r"\bDISM\b", r"DISM\s+(?<comp>[A-Za-z][A-Za-z0-9 .]*?):", True, TaskName="{comp}"),
        _field("dism-level", r",\s+(Info|Warning|Error|Verbose|Debug)\b", r",\s+(?<lvl>Info|Warning|Error|Verbose|Debug)\b", True),
        _field("dism-pid-tid", r"PID=\d+\s+TID=\d+", r"PID=(?<pid>\d+)\s+TID=(?<tid>\d+)", True, ProcessId="{pid}", ThreadId="{tid}"),
        _field("dism-bracket-pid-tid", r"^\[\d+\.\d+\]", r"^\[(?<pid>\d+)\.(?<tid>\d+)\]", True, ProcessId="{pid}", ThreadId="{tid}", Source="DISM"),
    ],
)
CBS_FIELDS = _pack(
    "CbsFields", "enrichment",
    [
        _field("cbs-line", r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}", r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}(\.\d+)?", True, Source="CBS"),
        _field("cbs-level", r",\s+(Info|Warning|Error|Verbose|Debug)\b", r",\s+(?<lvl>Info|Warning|Error|Verbose|Debug)\b", True),
        _field("cbs-component", r",\s+(?:Info|Warning|Error|Verbose|Debug)\s+(?:CBS|CSI|SXS|DPX|DWLD|WSP|SQM)\b", r"(?<=,\s{1,4}(?:Info|Warning|Error|Verbose|Debug)\s{1,40})(?<comp>CBS|CSI|SXS|DPX|DWLD|WSP|SQM)\b", True, TaskName="{comp}"),
        _field("cbs-hresult", r"\[HRESULT = 0x[0-9A-Fa-f]+", r"\[HRESULT = (?<hr>0x[0-9A-Fa-f]+)", False, EventId="{hr}"),
    ],
)
SETUP_FIELDS = _pack(
    "PantherFields", "enrichment",
    [
        _field("panther-line", r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2},\s+(Info|Warning|Error|Verbose|Debug)\b", r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}(\.\d+)?", True),
        _field("panther-level", r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2},\s+(Info|Warning|Error|Verbose|Debug)\b", r",\s+(?<lvl>Info|Warning|Error|Verbose|Debug)\b", True),
        _field("panther-component", r",\s+(?:Info|Warning|Error|Verbose|Debug)\s+[A-Z][A-Za-z0-9]{1,9}\s{2,}", r"(?<=,\s{1,4}(?:Info|Warning|Error|Verbose|Debug)\s{1,40})(?<comp>[A-Z][A-Za-z0-9]{1,9})(?=\s{2,})", True, TaskName="{comp}"),
        _field("panther-result", r"Result = 0x[0-9A-Fa-f]+", r"Result = (?<hr>0x[0-9A-Fa-f]+)", False, EventId="{hr}"),
        _field("panther-process", r"\[[A-Za-z0-9._-]+\.(?:exe|dll|sys)\]", r"\[(?<proc>[A-Za-z0-9._-]+\.(?:exe|dll|sys))\]\s?", True, TaskName="{proc}"),
    ],
)
UPDATE_FIELDS = _pack(
    "WuMessageCleanup", "enrichment",
    [
        _field("wu-task-level-prefix", r"^.+? == (Info|Warning|Error|Verbose|Debug|Critical|Trace):", r"^.+? == (?:Info|Warning|Error|Verbose|Debug|Critical|Trace):\s*", True),
        _field("wu-trailing-pipe", r"\|\s*$", r"\s*\|\s*$", True),
    ],
)
# Milestones of servicing sessions and of requests between processes, and the diagrams they make.
DISM_INTERACTION_UML = {
    "title": "DISM session interaction", "dedupe": True, "maxElements": 200,
    "participants": [_participant("API", "DismApi"), _participant("Mgr", "DISM Manager"), _participant("Store", "Provider Store"), _participant("Prov", "Imaging Providers")],
    "rules": [
        _element("api-session-start", r"Starting DismApi\.dll session", True, "note", "API", text="DismApi session start", notePosition="left"),
        _element("host-info", "Host machine information", False, "note", "API", text="OS {extract:OS Version=([0-9.]+)} ({extract:architecture=([a-z0-9]+)})", notePosition="over"),
        _element("api-active", "Created g_internalDismSession", False, "activate", "API"),
        _element("load-image-session", "Successfully loaded the ImageSession", False, "message", "API", "Mgr", "load local image session"),
        _element("create-image-session", "Successfully created the local image session and provider store", False, "message", "Mgr", "Store", "create image session + provider store"),
        _element("logger-ready", "Found and Initialized the DISM Logger", False, "note", "Store", text="provider store + logger ready", notePosition="over"),
        _element("provider-negotiate", "does not support CreateDismImage on", False, "message", "Store", "Prov", "{extract:provider ([A-Za-z]+) does not}: not for this image", arrowStyle="dashed"),
        _element("provider-selected", "Successfully created and initialized the image|The provider .* successfully created", True, "message", "Prov", "Mgr", "image provider selected", arrowStyle="response"),
        _element("session-shutdown", "DismShutdownInternal|Shutting down the DISM", True, "message", "Mgr", "API", "shutdown session", arrowStyle="response"),
        _element("api-deactivate", "DismShutdownInternal|Shutting down the DISM", True, "deactivate", "API"),
    ],
}
PROCESS_INTERACTION_UML = {
    "title": "Process interaction sequence",
    "participants": [_participant(n, n) for n in ("Client", "Broker", "Worker", "Store")],
    "rules": [
        _element("client-start", "Client process started", False, "note", "Client", text=r"pid={extract:pid=(\d+)}", notePosition="left"),
        _element("client-request", "Client sending request to Broker", False, "message", "Client", "Broker", r"request (req={extract:req=(\d+)})"),
        _element("broker-activate", "Broker received request", False, "activate", "Broker"),
        _element("broker-dispatch", "Broker dispatching to Worker", False, "message", "Broker", "Worker", r"dispatch job (worker pid={extract:pid=(\d+)})"),
        _element("worker-store", "Worker writing result to Store", False, "message", "Worker", "Store", "write result"),
        _element("store-ack", "Store persisted job", False, "message", "Store", "Worker", r"persisted job {extract:job (\d+)}"),
        _element("worker-return", "Worker returning result to Broker", False, "message", "Worker", "Broker", "result"),
        _element("broker-respond", "Broker responding to Client", False, "message", "Broker", "Client", "response"),
        _element("broker-deactivate", "Broker responding to Client", False, "deactivate", "Broker"),
    ],
}
# Which lines start a diagram or enter a report, and where that goes.
DISM_INTERACTION = _pack(
    "DismDiagram", "output",
    [
        _rule(
            "emit-dism-sequence", r"Starting DismApi\.dll session|Successfully loaded the ImageSession|Successfully created the local image session and provider store|does not support CreateDismImage on|DismShutdownInternal",
            {"type": "uml", "syntax": "mermaid", "path": "{output}/dism_interaction_{datetime}.mmd", "rulesFile": "CommonRules/dism-interaction-uml.rules.json", "generateImage": False},
        ),
    ],
)
PROCESS_INTERACTION = _pack(
    "ProcessDiagram", "output",
    [
        _rule(
            "emit-process-sequence", "Client sending request to Broker|Broker dispatching to Worker|Worker writing result to Store|Broker responding to Client",
            {"type": "uml", "syntax": "mermaid", "path": "{output}/process_interaction_{datetime}.mmd", "rulesFile": "CommonRules/process-interaction-uml.rules.json", "generateImage": True},
        ),
    ],
)
CRASH_DETECTION = _pack("CrashDetection", "filter", [_rule("keep-crashes", "crash|fault|unhandled exception|access violation|0xc0000005|stowed exception", {"type": "include"})])
CRASH_REPORT = _pack("CrashReport", "output", [_rule("emit-crash-report", CRASH, {"type": "output", "format": "txt", "path": "{output}/crash_report_{datetime}.txt", "fields": ["time", "source", "machine", "message"], "includeHeaders": True})])
POWER_TIMELINE = _pack("PowerTimeline", "output", [_rule("emit-power-timeline", POWER, {"type": "output", "format": "csv", "path": "{output}/machine_power_timeline_{datetime}.csv", "fields": ["time", "source", "message"], "includeHeaders": True})])

#: Diagram definitions by the name of their rule file.
DIAGRAMS = {"dism-interaction-uml.rules.json": DISM_INTERACTION_UML, "process-interaction-uml.rules.json": PROCESS_INTERACTION_UML}
#: All packs by the name of their rule file.
RULE_FILES = {
    "noise-filter.rules.json": NOISE_FILTER, "etw-crash-detection.rules.json": CRASH_DETECTION, "process-interaction.rules.json": PROCESS_INTERACTION, "pii-filter.rules.json": PII_FILTER,
    "pii-redact.rules.json": PII_REDACT, "dism-interaction.rules.json": DISM_INTERACTION, "dism-fields.rules.json": DISM_FIELDS, "cbs-fields.rules.json": CBS_FIELDS, "wu-fields.rules.json": UPDATE_FIELDS,
    "panther-fields.rules.json": SETUP_FIELDS, "crash-filter.rules.json": CRASH_FILTER, "crash-report.rules.json": CRASH_REPORT, "machine-power-filter.rules.json": POWER_FILTER, "machine-power-timeline.rules.json": POWER_TIMELINE,
}
# What must be among the loaded logs for a pack to apply by itself.
_CRASHES = ["Application Error", "Application Hang", "Windows Error Reporting", ".NET Runtime"]
_MACHINE = ["EventLog", "Microsoft-Windows-Kernel-General", "Microsoft-Windows-Kernel-Power", "Microsoft-Windows-Kernel-Boot"]
AUTO_PACKS = [
    {"ruleFile": "noise-filter.rules.json", "always": True},
    {"ruleFile": "etw-crash-detection.rules.json", "extensions": [".etl"], "sourceTypes": ["ETW"]},
    {"ruleFile": "process-interaction.rules.json", "pathGlobs": ["*process-interaction*"]},
    {"ruleFile": "pii-filter.rules.json", "always": True},
    {"ruleFile": "pii-redact.rules.json", "always": True},
    {"ruleFile": "dism-interaction.rules.json", "pathGlobs": ["*dism*"]},
    {"ruleFile": "dism-fields.rules.json", "pathGlobs": ["*dism*"]},
    {"ruleFile": "cbs-fields.rules.json", "pathGlobs": ["*cbs*", "*CBS*"]},
    {"ruleFile": "wu-fields.rules.json", "providers": ["WUTraceLogging"]},
    {"ruleFile": "panther-fields.rules.json", "pathGlobs": ["*panther*", "*Panther*", "*setupact*", "*setuperr*"]},
    {"ruleFile": "crash-filter.rules.json", "providers": _CRASHES},
    {"ruleFile": "crash-report.rules.json", "providers": _CRASHES},
    {"ruleFile": "machine-power-filter.rules.json", "providers": _MACHINE},
    {"ruleFile": "machine-power-timeline.rules.json", "providers": _MACHINE},
]
PACKS = {
    "pii_filter": PII_FILTER, "pii_redact": PII_REDACT, "noise_filter": NOISE_FILTER, "crash_filter": CRASH_FILTER, "power_filter": POWER_FILTER,
    "dism_fields": DISM_FIELDS, "cbs_fields": CBS_FIELDS, "setup_fields": SETUP_FIELDS, "update_fields": UPDATE_FIELDS,
    "crash_detection": CRASH_DETECTION, "crash_report": CRASH_REPORT, "power_timeline": POWER_TIMELINE, "dism_interaction": DISM_INTERACTION, "process_interaction": PROCESS_INTERACTION,
}
