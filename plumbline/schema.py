"""Fixed schemas and dimension tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

DEPENDENCY = "ecosystem string, name string, version string, direct boolean"
ADVISORY = "ecosystem string, name string, id string, aliases array<string>, severity string, summary string, source string, fixed_in string"

SEVERITIES = ("info", "low", "medium", "high", "critical")
VERDICTS = ("safe", "review", "prompt", "block")

# Ecosystem, OSV name, GHSA name, package-URL type, fetched for scans, eligible for reachability.
ECOSYSTEMS = [
    ("npm", "npm", "NPM", "npm", True, True),
    ("pypi", "PyPI", "PIP", "pypi", True, True),
    ("crates", "crates.io", "RUST", "cargo", True, False),
    ("go", "Go", "GO", "golang", True, True),
    ("maven", "Maven", "MAVEN", "maven", False, False),
    ("rubygems", "RubyGems", "RUBYGEMS", "gem", True, True),
    ("packagist", "Packagist", "COMPOSER", "composer", False, False),
    ("nuget", "NuGet", "NUGET", "nuget", False, True),
    ("hex", "Hex", "ERLANG", "hex", False, False),
    ("pub", "Pub", "PUB", "pub", False, False),
    ("swifturl", "SwiftURL", "SWIFT", "swift", False, False),
    ("cran", "CRAN", None, "cran", False, False),
    ("hackage", "Hackage", None, "hackage", False, False),
    ("cpan", None, None, "cpan", False, False),
    ("cocoapods", None, None, "cocoapods", False, False),
    ("neovim", None, None, "generic", False, False),
    ("aur", None, None, "generic", False, False),
    ("conan", None, None, "conan", False, False),
    ("nix", None, None, "generic", False, False),
    ("julia", None, None, "generic", False, False),
    ("conda", None, None, "conda", False, False),
    ("nim", None, None, "generic", False, False),
    ("elm", None, None, "generic", False, False),
    ("opam", None, None, "generic", False, False),
]

# Capability in its order, and the weight of its flag.
CAPABILITIES = [
    ("shell-spawn", 10), ("dynamic-eval", 15), ("base64-decode", 12), ("net-egress", 8), ("env-read", 15),
    ("fs-write-outside-root", 8), ("raw-ip-literal", 10), ("install-hook-exec", 20), ("install-hook-suspicious", 70),
    ("obfuscated-payload", 60), ("suspicious-url", 50), ("binary-dropper", 25), ("typosquat-risk", 45),
    ("maintainer-hijack-risk", 50), ("patch-version-drift", 35), ("maintainer-changed", 55), ("tarball-source-drift", 60),
    ("git-dep-in-optional", 65), ("unlisted-large-file", 55), ("version-unpublished", 75), ("known-malware-ioc", 100),
    ("vcs-dependency", 45), ("hardcoded-secret", 80),
]

# What a capability tells a reader of a report.
DESCRIPTIONS = {
    "shell-spawn": "starts other programs",
    "dynamic-eval": "runs code that it puts together while running",
    "base64-decode": "turns encoded text back into data",
    "net-egress": "talks to the network",
    "env-read": "reads environment variables; only names of credentials weigh",
    "fs-write-outside-root": "may write to files that are not its own",
    "raw-ip-literal": "names a host by a numeric address",
    "install-hook-exec": "has a script that runs on installation",
    "install-hook-suspicious": "its installation script fetches and runs something, or hides what it runs",
    "obfuscated-payload": "runs what it has just decoded",
    "suspicious-url": "has an address at a host for pastes, tunnels or chat hooks",
    "binary-dropper": "carries a program file",
    "typosquat-risk": "is named almost like a popular package",
    "maintainer-hijack-risk": "was published just now after a long silence, with few users",
    "patch-version-drift": "can do more than before although only the patch number rose",
    "tarball-source-drift": "has files in its archive that its repository does not have",
    "maintainer-changed": "comes from another publisher than the version before",
    "git-dep-in-optional": "has an optional dependency on a repository",
    "unlisted-large-file": "has a large script that its manifest does not list",
    "version-unpublished": "is of a version that was withdrawn",
    "known-malware-ioc": "has a file named like one of a known attack",
    "vcs-dependency": "has a dependency on a repository instead of a registry",
    "hardcoded-secret": "has a secret in its source",
}

# Weights of flags that are no capabilities, and score thresholds of verdicts.
HOOK_WEIGHT, HOOK_CHANGED_WEIGHT, CAPABILITY_ADDED_WEIGHT, SIZE_WEIGHT, PROVENANCE_WEIGHT = 30, 30, 15, 5, 10
REVIEW, PROMPT, BLOCK = 21, 61, 100


def ecosystem_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ECOSYSTEMS, "ecosystem string, osv string, ghsa string, purl_type string, enriched boolean, reach_eligible boolean")


def capability_dim(spark: SparkSession) -> DataFrame:
    rows = [(i + 1, c, "env-cred-read" if c == "env-read" else c, w, DESCRIPTIONS[c]) for i, (c, w) in enumerate(CAPABILITIES)]
    return spark.createDataFrame(rows, "ord int, capability string, code string, weight int, description string")
