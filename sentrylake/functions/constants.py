"""Fixed values that results depend on: names, markers and techniques."""

# Directories, programs and record types.
SYSTEM_DIRS = ("/usr/bin/", "/bin/", "/usr/sbin/", "/sbin/", "/usr/libexec/", "/usr/lib/")
SHELLS = ("bash", "sh", "dash", "zsh", "ash", "ksh", "csh", "tcsh", "fish")
INTERPRETERS = ("python", "python2", "python3", "perl", "ruby", "php", "node", "nodejs", "lua", "awk", "gawk", "tclsh")
NET_TOOLS = ("nc", "ncat", "netcat", "socat", "curl", "wget", "ssh", "scp", "sftp", "rsync", "ftp", "tftp")
SCANNERS = ("nmap", "masscan", "zmap", "rustscan", "unicornscan")
CRED_TOOLS = ("passwd", "chpasswd", "gpasswd", "useradd", "adduser", "usermod", "userdel", "groupadd", "getent")
AUTH_TYPES = ("USER_AUTH", "USER_LOGIN", "USER_ACCT", "CRED_ACQ", "CRED_REFR", "LOGIN", "USER_START")
CHILD_TYPES = ("PATH", "CWD", "PROCTITLE", "EXECVE", "SOCKADDR")
ACCOUNT_TYPES = ("ADD_USER", "ADD_GROUP", "USER_MGMT", "GRP_MGMT", "ROLE_ASSIGN")
SERVICE_PROGRAMS = ("systemctl", "service", "kill", "killall", "pkill", "shutdown", "reboot", "init")
PLACEHOLDERS = ("unset", "?", "(unknown)", "unknown", "n/a")
UID_NAMES = {0: "root", 1: "daemon", 33: "www-data", 101: "systemd-network", 999: "systemd-coredump"}

# Parts of paths and command lines.
SENSITIVE = ("/etc/shadow", "/etc/passwd", "/etc/sudoers", "/etc/gshadow", "/.ssh/", "id_rsa", "id_ed25519", "authorized_keys", "/etc/cron", "/etc/systemd/system", "/var/log/", ".bash_history", "/root/", "/boot/")
PERSISTENCE = ("/etc/cron", "/etc/systemd", "/lib/systemd", "/etc/sudoers", "/etc/passwd", "/root/.ssh", "authorized_keys", "/boot/")
REVERSE_SHELL = ("/dev/tcp/", "/dev/udp/", "-e /bin/sh", "-e /bin/bash", "bash -i", "sh -i", "mkfifo")
PRIVILEGED_KEYS = ("privileged_commands", "privileged", "identity", "logins", "sudoers", "sudo", "audit_rules", "audit-config", "power", "modules", "kernel_modules", "shadow", "passwd_changes", "perm_mod", "rootcmd")
WRITE_CALLS = ("write", "pwrite64", "writev", "openat", "open", "creat", "unlink", "unlinkat", "rename", "renameat", "renameat2", "truncate", "ftruncate", "link", "linkat", "symlink", "symlinkat", "mknod", "mknodat")
INTEGRITY_CALLS = ("write", "openat", "open", "unlink", "unlinkat", "rename", "renameat", "truncate", "ftruncate", "chmod", "fchmod", "fchmodat", "chown", "fchown", "link", "linkat", "symlink", "symlinkat", "init_module", "finit_module")
RISKY_PORTS = (22, 23, 3389, 445, 139, 5985, 5986)
COMMON_PORTS = (80, 443, 53, 123, 587, 993, 995, 25)

# Tactics, and technique -> (tactic, name, base severity).
TACTICS = {
    "TA0001": "Initial Access",
    "TA0002": "Execution",
    "TA0003": "Persistence",
    "TA0004": "Privilege Escalation",
    "TA0005": "Defense Evasion",
    "TA0006": "Credential Access",
    "TA0007": "Discovery",
    "TA0008": "Lateral Movement",
    "TA0011": "Command and Control",
}
TECHNIQUES = {
    "T1003.008": ("TA0006", "OS Credential Dumping: /etc/passwd and /etc/shadow", 0.8),
    "T1018": ("TA0007", "Remote System Discovery", 0.35),
    "T1021.004": ("TA0008", "Remote Services: SSH", 0.5),
    "T1046": ("TA0007", "Network Service Discovery", 0.55),
    "T1053.003": ("TA0003", "Scheduled Task/Job: Cron", 0.55),
    "T1059.004": ("TA0002", "Command and Scripting Interpreter: Unix Shell", 0.45),
    "T1059.006": ("TA0002", "Command and Scripting Interpreter: Python", 0.5),
    "T1070.002": ("TA0005", "Indicator Removal: Clear Linux or Mac System Logs", 0.7),
    "T1070.003": ("TA0005", "Indicator Removal: Clear Command History", 0.6),
    "T1071": ("TA0011", "Application Layer Protocol", 0.4),
    "T1078": ("TA0005", "Valid Accounts", 0.4),
    "T1098": ("TA0003", "Account Manipulation", 0.55),
    "T1105": ("TA0011", "Ingress Tool Transfer", 0.6),
    "T1110": ("TA0006", "Brute Force", 0.7),
    "T1136.001": ("TA0003", "Create Account: Local Account", 0.6),
    "T1204.002": ("TA0002", "User Execution: Malicious File", 0.4),
    "T1219": ("TA0011", "Remote Access Software", 0.6),
    "T1222.002": ("TA0005", "File and Directory Permissions Modification: Linux and Mac", 0.4),
    "T1543.002": ("TA0003", "Create or Modify System Process: Systemd Service", 0.55),
    "T1547.006": ("TA0003", "Boot or Logon Autostart Execution: Kernel Modules and Extensions", 0.6),
    "T1548.001": ("TA0004", "Abuse Elevation Control Mechanism: Setuid and Setgid", 0.55),
    "T1548.003": ("TA0004", "Abuse Elevation Control Mechanism: Sudo and Sudo Caching", 0.45),
    "T1552.004": ("TA0006", "Unsecured Credentials: Private Keys", 0.7),
    "T1562.001": ("TA0005", "Impair Defenses: Disable or Modify Tools", 0.75),
    "T1571": ("TA0011", "Non-Standard Port", 0.55),
}
