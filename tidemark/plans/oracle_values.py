"""Values of the SQL that queries are compared with, written out on their own and not read from the code under test."""

# System calls as rows of SQL (table, number, name, kind).
CALLS = """
('x86_64', 0, 'read', 'file'),
('x86_64', 1, 'write', 'file'),
('x86_64', 2, 'open', 'file'),
('x86_64', 3, 'close', 'file'),
('x86_64', 4, 'stat', 'file-meta'),
('x86_64', 5, 'fstat', 'file-meta'),
('x86_64', 6, 'lstat', 'file-meta'),
('x86_64', 7, 'poll', 'other'),
('x86_64', 8, 'lseek', 'file-meta'),
('x86_64', 9, 'mmap', 'file'),
('x86_64', 10, 'mprotect', 'other'),
('x86_64', 11, 'munmap', 'other'),
('x86_64', 12, 'brk', 'other'),
('x86_64', 13, 'rt_sigaction', 'other'),
('x86_64', 14, 'rt_sigprocmask', 'other'),
('x86_64', 15, 'rt_sigreturn', 'other'),
('x86_64', 16, 'ioctl', 'file-meta'),
('x86_64', 17, 'pread64', 'file'),
('x86_64', 18, 'pwrite64', 'file'),
('x86_64', 19, 'readv', 'file'),
('x86_64', 20, 'writev', 'file'),
('x86_64', 21, 'access', 'file-meta'),
('x86_64', 22, 'pipe', 'other'),
('x86_64', 23, 'select', 'other'),
('x86_64', 24, 'sched_yield', 'other'),
('x86_64', 25, 'mremap', 'file'),
('x86_64', 26, 'msync', 'file'),
('x86_64', 27, 'mincore', 'other'),
('x86_64', 28, 'madvise', 'other'),
('x86_64', 29, 'shmget', 'file'),
('x86_64', 30, 'shmat', 'file'),
('x86_64', 31, 'shmctl', 'other'),
('x86_64', 32, 'dup', 'file-meta'),
('x86_64', 33, 'dup2', 'file-meta'),
('x86_64', 34, 'pause', 'other'),
('x86_64', 35, 'nanosleep', 'other'),
('x86_64', 36, 'getitimer', 'other'),
('x86_64', 37, 'alarm', 'other'),
('x86_64', 38, 'setitimer', 'other'),
('x86_64', 39, 'getpid', 'other'),
('x86_64', 40, 'sendfile', 'file'),
('x86_64', 41, 'socket', 'socket'),
('x86_64', 42, 'connect', 'net-connect'),
('x86_64', 43, 'accept', 'net-accept'),
('x86_64', 44, 'sendto', 'net-send'),
('x86_64', 45, 'recvfrom', 'net-recv'),
('x86_64', 46, 'sendmsg', 'net-send'),
('x86_64', 47, 'recvmsg', 'net-recv'),
('x86_64', 48, 'shutdown', 'socket'),
('x86_64', 49, 'bind', 'socket'),
('x86_64', 50, 'listen', 'socket'),
('x86_64', 51, 'getsockname', 'socket'),
('x86_64', 52, 'getpeername', 'socket'),
('x86_64', 53, 'socketpair', 'socket'),
('x86_64', 54, 'setsockopt', 'socket'),
('x86_64', 55, 'getsockopt', 'socket'),
('x86_64', 56, 'clone', 'other'),
('x86_64', 57, 'fork', 'other'),
('x86_64', 58, 'vfork', 'other'),
('x86_64', 59, 'execve', 'exec'),
('x86_64', 60, 'exit', 'other'),
('x86_64', 61, 'wait4', 'other'),
('x86_64', 62, 'kill', 'other'),
('x86_64', 63, 'uname', 'other'),
('x86_64', 64, 'semget', 'other'),
('x86_64', 65, 'semop', 'other'),
('x86_64', 66, 'semctl', 'other'),
('x86_64', 67, 'shmdt', 'other'),
('x86_64', 68, 'msgget', 'other'),
('x86_64', 69, 'msgsnd', 'other'),
('x86_64', 70, 'msgrcv', 'other'),
('x86_64', 71, 'msgctl', 'other'),
('x86_64', 72, 'fcntl', 'file-meta'),
('x86_64', 73, 'flock', 'file-meta'),
('x86_64', 74, 'fsync', 'file-meta'),
('x86_64', 75, 'fdatasync', 'file-meta'),
('x86_64', 76, 'truncate', 'file'),
('x86_64', 77, 'ftruncate', 'file'),
('x86_64', 78, 'getdents', 'file-meta'),
('x86_64', 79, 'getcwd', 'file-meta'),
('x86_64', 80, 'chdir', 'file-meta'),
('x86_64', 81, 'fchdir', 'file-meta'),
('x86_64', 82, 'rename', 'file'),
('x86_64', 83, 'mkdir', 'file'),
('x86_64', 84, 'rmdir', 'file'),
('x86_64', 85, 'creat', 'file'),
('x86_64', 86, 'link', 'file'),
('x86_64', 87, 'unlink', 'file'),
('x86_64', 88, 'symlink', 'file'),
('x86_64', 89, 'readlink', 'file-meta'),
('x86_64', 90, 'chmod', 'file'),
('x86_64', 91, 'fchmod', 'file'),
('x86_64', 92, 'chown', 'file'),
('x86_64', 93, 'fchown', 'file'),
('x86_64', 94, 'lchown', 'file'),
('x86_64', 95, 'umask', 'file-meta'),
('x86_64', 96, 'gettimeofday', 'other'),
('x86_64', 97, 'getrlimit', 'other'),
('x86_64', 98, 'getrusage', 'other'),
('x86_64', 99, 'sysinfo', 'other'),
('x86_64', 100, 'times', 'other'),
('x86_64', 101, 'ptrace', 'other'),
('x86_64', 102, 'getuid', 'other'),
('x86_64', 103, 'syslog', 'other'),
('x86_64', 104, 'getgid', 'other'),
('x86_64', 105, 'setuid', 'other'),
('x86_64', 106, 'setgid', 'other'),
('x86_64', 107, 'geteuid', 'other'),
('x86_64', 108, 'getegid', 'other'),
('x86_64', 109, 'setpgid', 'other'),
('x86_64', 110, 'getppid', 'other'),
('x86_64', 111, 'getpgrp', 'other'),
('x86_64', 112, 'setsid', 'other'),
('x86_64', 113, 'setreuid', 'other'),
('x86_64', 114, 'setregid', 'other'),
('x86_64', 115, 'getgroups', 'other'),
('x86_64', 116, 'setgroups', 'other'),
('x86_64', 117, 'setresuid', 'other'),
('x86_64', 118, 'getresuid', 'other'),
('x86_64', 119, 'setresgid', 'other'),
('x86_64', 120, 'getresgid', 'other'),
('x86_64', 121, 'getpgid', 'other'),
('x86_64', 122, 'setfsuid', 'other'),
('x86_64', 123, 'setfsgid', 'other'),
('x86_64', 124, 'getsid', 'other'),
('x86_64', 125, 'capget', 'other'),
('x86_64', 126, 'capset', 'other'),
('x86_64', 127, 'rt_sigpending', 'other'),
('x86_64', 128, 'rt_sigtimedwait', 'other'),
('x86_64', 129, 'rt_sigqueueinfo', 'other'),
('x86_64', 130, 'rt_sigsuspend', 'other'),
('x86_64', 131, 'sigaltstack', 'other'),
('x86_64', 132, 'utime', 'other'),
('x86_64', 133, 'mknod', 'file'),
('x86_64', 134, 'uselib', 'other'),
('x86_64', 135, 'personality', 'other'),
('x86_64', 136, 'ustat', 'other'),
('x86_64', 137, 'statfs', 'file-meta'),
('x86_64', 138, 'fstatfs', 'file-meta'),
('x86_64', 139, 'sysfs', 'other'),
('x86_64', 140, 'getpriority', 'other'),
('x86_64', 141, 'setpriority', 'other'),
('x86_64', 142, 'sched_setparam', 'other'),
('x86_64', 143, 'sched_getparam', 'other'),
('x86_64', 144, 'sched_setscheduler', 'other'),
('x86_64', 145, 'sched_getscheduler', 'other'),
('x86_64', 146, 'sched_get_priority_max', 'other'),
('x86_64', 147, 'sched_get_priority_min', 'other'),
('x86_64', 148, 'sched_rr_get_interval', 'other'),
('x86_64', 149, 'mlock', 'other'),
('x86_64', 150, 'munlock', 'other'),
('x86_64', 151, 'mlockall', 'other'),
('x86_64', 152, 'munlockall', 'other'),
('x86_64', 153, 'vhangup', 'other'),
('x86_64', 154, 'modify_ldt', 'other'),
('x86_64', 155, 'pivot_root', 'other'),
('x86_64', 156, '_sysctl', 'other'),
('x86_64', 157, 'prctl', 'other'),
('x86_64', 158, 'arch_prctl', 'other'),
('x86_64', 159, 'adjtimex', 'other'),
('x86_64', 160, 'setrlimit', 'other'),
('x86_64', 161, 'chroot', 'other'),
('x86_64', 162, 'sync', 'file-meta'),
('x86_64', 163, 'acct', 'other'),
('x86_64', 164, 'settimeofday', 'other'),
('x86_64', 165, 'mount', 'other'),
('x86_64', 166, 'umount2', 'other'),
('x86_64', 167, 'swapon', 'other'),
('x86_64', 168, 'swapoff', 'other'),
('x86_64', 169, 'reboot', 'other'),
('x86_64', 170, 'sethostname', 'other'),
('x86_64', 171, 'setdomainname', 'other'),
('x86_64', 172, 'iopl', 'other'),
('x86_64', 173, 'ioperm', 'other'),
('x86_64', 174, 'create_module', 'other'),
('x86_64', 175, 'init_module', 'other'),
('x86_64', 176, 'delete_module', 'other'),
('x86_64', 177, 'get_kernel_syms', 'other'),
('x86_64', 178, 'query_module', 'other'),
('x86_64', 179, 'quotactl', 'other'),
('x86_64', 180, 'nfsservctl', 'other'),
('x86_64', 181, 'getpmsg', 'other'),
('x86_64', 182, 'putpmsg', 'other'),
('x86_64', 183, 'afs_syscall', 'other'),
('x86_64', 184, 'tuxcall', 'other'),
('x86_64', 185, 'security', 'other'),
('x86_64', 186, 'gettid', 'other'),
('x86_64', 187, 'readahead', 'other'),
('x86_64', 188, 'setxattr', 'file'),
('x86_64', 189, 'lsetxattr', 'file'),
('x86_64', 190, 'fsetxattr', 'file'),
('x86_64', 191, 'getxattr', 'other'),
('x86_64', 192, 'lgetxattr', 'other'),
('x86_64', 193, 'fgetxattr', 'other'),
('x86_64', 194, 'listxattr', 'other'),
('x86_64', 195, 'llistxattr', 'other'),
('x86_64', 196, 'flistxattr', 'other'),
('x86_64', 197, 'removexattr', 'file'),
('x86_64', 198, 'lremovexattr', 'file'),
('x86_64', 199, 'fremovexattr', 'file'),
('x86_64', 200, 'tkill', 'other'),
('x86_64', 201, 'time', 'other'),
('x86_64', 202, 'futex', 'other'),
('x86_64', 203, 'sched_setaffinity', 'other'),
('x86_64', 204, 'sched_getaffinity', 'other'),
('x86_64', 205, 'set_thread_area', 'other'),
('x86_64', 206, 'io_setup', 'other'),
('x86_64', 207, 'io_destroy', 'other'),
('x86_64', 208, 'io_getevents', 'other'),
('x86_64', 209, 'io_submit', 'other'),
('x86_64', 210, 'io_cancel', 'other'),
('x86_64', 211, 'get_thread_area', 'other'),
('x86_64', 212, 'lookup_dcookie', 'other'),
('x86_64', 213, 'epoll_create', 'other'),
('x86_64', 214, 'epoll_ctl_old', 'other'),
('x86_64', 215, 'epoll_wait_old', 'other'),
('x86_64', 216, 'remap_file_pages', 'other'),
('x86_64', 217, 'getdents64', 'file-meta'),
('x86_64', 218, 'set_tid_address', 'other'),
('x86_64', 219, 'restart_syscall', 'other'),
('x86_64', 220, 'semtimedop', 'other'),
('x86_64', 221, 'fadvise64', 'other'),
('x86_64', 222, 'timer_create', 'other'),
('x86_64', 223, 'timer_settime', 'other'),
('x86_64', 224, 'timer_gettime', 'other'),
('x86_64', 225, 'timer_getoverrun', 'other'),
('x86_64', 226, 'timer_delete', 'other'),
('x86_64', 227, 'clock_settime', 'other'),
('x86_64', 228, 'clock_gettime', 'other'),
('x86_64', 229, 'clock_getres', 'other'),
('x86_64', 230, 'clock_nanosleep', 'other'),
('x86_64', 231, 'exit_group', 'other'),
('x86_64', 232, 'epoll_wait', 'other'),
('x86_64', 233, 'epoll_ctl', 'other'),
('x86_64', 234, 'tgkill', 'other'),
('x86_64', 235, 'utimes', 'file-meta'),
('x86_64', 236, 'vserver', 'other'),
('x86_64', 237, 'mbind', 'other'),
('x86_64', 238, 'set_mempolicy', 'other'),
('x86_64', 239, 'get_mempolicy', 'other'),
('x86_64', 240, 'mq_open', 'other'),
('x86_64', 241, 'mq_unlink', 'other'),
('x86_64', 242, 'mq_timedsend', 'other'),
('x86_64', 243, 'mq_timedreceive', 'other'),
('x86_64', 244, 'mq_notify', 'other'),
('x86_64', 245, 'mq_getsetattr', 'other'),
('x86_64', 246, 'kexec_load', 'other'),
('x86_64', 247, 'waitid', 'other'),
('x86_64', 248, 'add_key', 'other'),
('x86_64', 249, 'request_key', 'other'),
('x86_64', 250, 'keyctl', 'other'),
('x86_64', 251, 'ioprio_set', 'other'),
('x86_64', 252, 'ioprio_get', 'other'),
('x86_64', 253, 'inotify_init', 'other'),
('x86_64', 254, 'inotify_add_watch', 'other'),
('x86_64', 255, 'inotify_rm_watch', 'other'),
('x86_64', 256, 'migrate_pages', 'other'),
('x86_64', 257, 'openat', 'file'),
('x86_64', 258, 'mkdirat', 'file'),
('x86_64', 259, 'mknodat', 'file'),
('x86_64', 260, 'fchownat', 'file'),
('x86_64', 261, 'futimesat', 'file-meta'),
('x86_64', 262, 'newfstatat', 'file-meta'),
('x86_64', 263, 'unlinkat', 'file'),
('x86_64', 264, 'renameat', 'file'),
('x86_64', 265, 'linkat', 'file'),
('x86_64', 266, 'symlinkat', 'file'),
('x86_64', 267, 'readlinkat', 'file-meta'),
('x86_64', 268, 'fchmodat', 'file'),
('x86_64', 269, 'faccessat', 'file-meta'),
('x86_64', 270, 'pselect6', 'other'),
('x86_64', 271, 'ppoll', 'other'),
('x86_64', 272, 'unshare', 'other'),
('x86_64', 273, 'set_robust_list', 'other'),
('x86_64', 274, 'get_robust_list', 'other'),
('x86_64', 275, 'splice', 'file'),
('x86_64', 276, 'tee', 'file'),
('x86_64', 277, 'sync_file_range', 'other'),
('x86_64', 278, 'vmsplice', 'file'),
('x86_64', 279, 'move_pages', 'other'),
('x86_64', 280, 'utimensat', 'file-meta'),
('x86_64', 281, 'epoll_pwait', 'other'),
('x86_64', 282, 'signalfd', 'other'),
('x86_64', 283, 'timerfd_create', 'other'),
('x86_64', 284, 'eventfd', 'other'),
('x86_64', 285, 'fallocate', 'file'),
('x86_64', 286, 'timerfd_settime', 'other'),
('x86_64', 287, 'timerfd_gettime', 'other'),
('x86_64', 288, 'accept4', 'net-accept'),
('x86_64', 289, 'signalfd4', 'other'),
('x86_64', 290, 'eventfd2', 'other'),
('x86_64', 291, 'epoll_create1', 'other'),
('x86_64', 292, 'dup3', 'file-meta'),
('x86_64', 293, 'pipe2', 'other'),
('x86_64', 294, 'inotify_init1', 'other'),
('x86_64', 295, 'preadv', 'file'),
('x86_64', 296, 'pwritev', 'file'),
('x86_64', 297, 'rt_tgsigqueueinfo', 'other'),
('x86_64', 298, 'perf_event_open', 'other'),
('x86_64', 299, 'recvmmsg', 'net-recv'),
('x86_64', 300, 'fanotify_init', 'other'),
('x86_64', 301, 'fanotify_mark', 'other'),
('x86_64', 302, 'prlimit64', 'other'),
('x86_64', 303, 'name_to_handle_at', 'other'),
('x86_64', 304, 'open_by_handle_at', 'other'),
('x86_64', 305, 'clock_adjtime', 'other'),
('x86_64', 306, 'syncfs', 'file-meta'),
('x86_64', 307, 'sendmmsg', 'net-send'),
('x86_64', 308, 'setns', 'other'),
('x86_64', 309, 'getcpu', 'other'),
('x86_64', 310, 'process_vm_readv', 'other'),
('x86_64', 311, 'process_vm_writev', 'other'),
('x86_64', 312, 'kcmp', 'other'),
('x86_64', 313, 'finit_module', 'other'),
('x86_64', 314, 'sched_setattr', 'other'),
('x86_64', 315, 'sched_getattr', 'other'),
('x86_64', 316, 'renameat2', 'file'),
('x86_64', 317, 'seccomp', 'other'),
('x86_64', 318, 'getrandom', 'other'),
('x86_64', 319, 'memfd_create', 'other'),
('x86_64', 320, 'kexec_file_load', 'other'),
('x86_64', 321, 'bpf', 'other'),
('x86_64', 322, 'execveat', 'exec'),
('x86_64', 323, 'userfaultfd', 'other'),
('x86_64', 324, 'membarrier', 'other'),
('x86_64', 325, 'mlock2', 'other'),
('x86_64', 326, 'copy_file_range', 'file'),
('x86_64', 327, 'preadv2', 'file'),
('x86_64', 328, 'pwritev2', 'file'),
('x86_64', 329, 'pkey_mprotect', 'other'),
('x86_64', 330, 'pkey_alloc', 'other'),
('x86_64', 331, 'pkey_free', 'other'),
('x86_64', 332, 'statx', 'file-meta'),
('x86_64', 333, 'io_pgetevents', 'other'),
('x86_64', 334, 'rseq', 'other'),
('x86_64', 335, 'uretprobe', 'other'),
('x86_64', 424, 'pidfd_send_signal', 'other'),
('x86_64', 425, 'io_uring_setup', 'other'),
('x86_64', 426, 'io_uring_enter', 'other'),
('x86_64', 427, 'io_uring_register', 'other'),
('x86_64', 428, 'open_tree', 'other'),
('x86_64', 429, 'move_mount', 'other'),
('x86_64', 430, 'fsopen', 'other'),
('x86_64', 431, 'fsconfig', 'other'),
('x86_64', 432, 'fsmount', 'other'),
('x86_64', 433, 'fspick', 'other'),
('x86_64', 434, 'pidfd_open', 'other'),
('x86_64', 435, 'clone3', 'other'),
('x86_64', 436, 'close_range', 'other'),
('x86_64', 437, 'openat2', 'file'),
('x86_64', 438, 'pidfd_getfd', 'other'),
('x86_64', 439, 'faccessat2', 'file-meta'),
('x86_64', 440, 'process_madvise', 'other'),
('x86_64', 441, 'epoll_pwait2', 'other'),
('x86_64', 442, 'mount_setattr', 'other'),
('x86_64', 443, 'quotactl_fd', 'other'),
('x86_64', 444, 'landlock_create_ruleset', 'other'),
('x86_64', 445, 'landlock_add_rule', 'other'),
('x86_64', 446, 'landlock_restrict_self', 'other'),
('x86_64', 447, 'memfd_secret', 'other'),
('x86_64', 448, 'process_mrelease', 'other'),
('x86_64', 449, 'futex_waitv', 'other'),
('x86_64', 450, 'set_mempolicy_home_node', 'other'),
('x86_64', 451, 'cachestat', 'other'),
('x86_64', 452, 'fchmodat2', 'other'),
('x86_64', 453, 'map_shadow_stack', 'other'),
('x86_64', 454, 'futex_wake', 'other'),
('x86_64', 455, 'futex_wait', 'other'),
('x86_64', 456, 'futex_requeue', 'other'),
('x86_64', 457, 'statmount', 'other'),
('x86_64', 458, 'listmount', 'other'),
('x86_64', 459, 'lsm_get_self_attr', 'other'),
('x86_64', 460, 'lsm_set_self_attr', 'other'),
('x86_64', 461, 'lsm_list_modules', 'other'),
('x86_64', 462, 'mseal', 'other'),
('i386', 0, 'restart_syscall', 'other'),
('i386', 1, 'exit', 'other'),
('i386', 2, 'fork', 'other'),
('i386', 3, 'read', 'file'),
('i386', 4, 'write', 'file'),
('i386', 5, 'open', 'file'),
('i386', 6, 'close', 'file'),
('i386', 7, 'waitpid', 'other'),
('i386', 8, 'creat', 'file'),
('i386', 9, 'link', 'file'),
('i386', 10, 'unlink', 'file'),
('i386', 11, 'execve', 'exec'),
('i386', 12, 'chdir', 'file-meta'),
('i386', 13, 'time', 'other'),
('i386', 14, 'mknod', 'file'),
('i386', 15, 'chmod', 'file'),
('i386', 16, 'lchown', 'file'),
('i386', 17, 'break', 'other'),
('i386', 18, 'oldstat', 'other'),
('i386', 19, 'lseek', 'file-meta'),
('i386', 20, 'getpid', 'other'),
('i386', 21, 'mount', 'other'),
('i386', 22, 'umount', 'other'),
('i386', 23, 'setuid', 'other'),
('i386', 24, 'getuid', 'other'),
('i386', 25, 'stime', 'other'),
('i386', 26, 'ptrace', 'other'),
('i386', 27, 'alarm', 'other'),
('i386', 28, 'oldfstat', 'other'),
('i386', 29, 'pause', 'other'),
('i386', 30, 'utime', 'other'),
('i386', 31, 'stty', 'other'),
('i386', 32, 'gtty', 'other'),
('i386', 33, 'access', 'file-meta'),
('i386', 34, 'nice', 'other'),
('i386', 35, 'ftime', 'other'),
('i386', 36, 'sync', 'file-meta'),
('i386', 37, 'kill', 'other'),
('i386', 38, 'rename', 'file'),
('i386', 39, 'mkdir', 'file'),
('i386', 40, 'rmdir', 'file'),
('i386', 41, 'dup', 'file-meta'),
('i386', 42, 'pipe', 'other'),
('i386', 43, 'times', 'other'),
('i386', 44, 'prof', 'other'),
('i386', 45, 'brk', 'other'),
('i386', 46, 'setgid', 'other'),
('i386', 47, 'getgid', 'other'),
('i386', 48, 'signal', 'other'),
('i386', 49, 'geteuid', 'other'),
('i386', 50, 'getegid', 'other'),
('i386', 51, 'acct', 'other'),
('i386', 52, 'umount2', 'other'),
('i386', 53, 'lock', 'other'),
('i386', 54, 'ioctl', 'file-meta'),
('i386', 55, 'fcntl', 'file-meta'),
('i386', 56, 'mpx', 'other'),
('i386', 57, 'setpgid', 'other'),
('i386', 58, 'ulimit', 'other'),
('i386', 59, 'oldolduname', 'other'),
('i386', 60, 'umask', 'file-meta'),
('i386', 61, 'chroot', 'other'),
('i386', 62, 'ustat', 'other'),
('i386', 63, 'dup2', 'file-meta'),
('i386', 64, 'getppid', 'other'),
('i386', 65, 'getpgrp', 'other'),
('i386', 66, 'setsid', 'other'),
('i386', 67, 'sigaction', 'other'),
('i386', 68, 'sgetmask', 'other'),
('i386', 69, 'ssetmask', 'other'),
('i386', 70, 'setreuid', 'other'),
('i386', 71, 'setregid', 'other'),
('i386', 72, 'sigsuspend', 'other'),
('i386', 73, 'sigpending', 'other'),
('i386', 74, 'sethostname', 'other'),
('i386', 75, 'setrlimit', 'other'),
('i386', 76, 'getrlimit', 'other'),
('i386', 77, 'getrusage', 'other'),
('i386', 78, 'gettimeofday', 'other'),
('i386', 79, 'settimeofday', 'other'),
('i386', 80, 'getgroups', 'other'),
('i386', 81, 'setgroups', 'other'),
('i386', 82, 'select', 'other'),
('i386', 83, 'symlink', 'file'),
('i386', 84, 'oldlstat', 'other'),
('i386', 85, 'readlink', 'file-meta'),
('i386', 86, 'uselib', 'other'),
('i386', 87, 'swapon', 'other'),
('i386', 88, 'reboot', 'other'),
('i386', 89, 'readdir', 'other'),
('i386', 90, 'mmap', 'file'),
('i386', 91, 'munmap', 'other'),
('i386', 92, 'truncate', 'file'),
('i386', 93, 'ftruncate', 'file'),
('i386', 94, 'fchmod', 'file'),
('i386', 95, 'fchown', 'file'),
('i386', 96, 'getpriority', 'other'),
('i386', 97, 'setpriority', 'other'),
('i386', 98, 'profil', 'other'),
('i386', 99, 'statfs', 'file-meta'),
('i386', 100, 'fstatfs', 'file-meta'),
('i386', 101, 'ioperm', 'other'),
('i386', 102, 'socketcall', 'other'),
('i386', 103, 'syslog', 'other'),
('i386', 104, 'setitimer', 'other'),
('i386', 105, 'getitimer', 'other'),
('i386', 106, 'stat', 'file-meta'),
('i386', 107, 'lstat', 'file-meta'),
('i386', 108, 'fstat', 'file-meta'),
('i386', 109, 'olduname', 'other'),
('i386', 110, 'iopl', 'other'),
('i386', 111, 'vhangup', 'other'),
('i386', 112, 'idle', 'other'),
('i386', 113, 'vm86old', 'other'),
('i386', 114, 'wait4', 'other'),
('i386', 115, 'swapoff', 'other'),
('i386', 116, 'sysinfo', 'other'),
('i386', 117, 'ipc', 'other'),
('i386', 118, 'fsync', 'file-meta'),
('i386', 119, 'sigreturn', 'other'),
('i386', 120, 'clone', 'other'),
('i386', 121, 'setdomainname', 'other'),
('i386', 122, 'uname', 'other'),
('i386', 123, 'modify_ldt', 'other'),
('i386', 124, 'adjtimex', 'other'),
('i386', 125, 'mprotect', 'other'),
('i386', 126, 'sigprocmask', 'other'),
('i386', 127, 'create_module', 'other'),
('i386', 128, 'init_module', 'other'),
('i386', 129, 'delete_module', 'other'),
('i386', 130, 'get_kernel_syms', 'other'),
('i386', 131, 'quotactl', 'other'),
('i386', 132, 'getpgid', 'other'),
('i386', 133, 'fchdir', 'file-meta'),
('i386', 134, 'bdflush', 'other'),
('i386', 135, 'sysfs', 'other'),
('i386', 136, 'personality', 'other'),
('i386', 137, 'afs_syscall', 'other'),
('i386', 138, 'setfsuid', 'other'),
('i386', 139, 'setfsgid', 'other'),
('i386', 140, '_llseek', 'other'),
('i386', 141, 'getdents', 'file-meta'),
('i386', 142, '_newselect', 'other'),
('i386', 143, 'flock', 'file-meta'),
('i386', 144, 'msync', 'file'),
('i386', 145, 'readv', 'file'),
('i386', 146, 'writev', 'file'),
('i386', 147, 'getsid', 'other'),
('i386', 148, 'fdatasync', 'file-meta'),
('i386', 149, '_sysctl', 'other'),
('i386', 150, 'mlock', 'other'),
('i386', 151, 'munlock', 'other'),
('i386', 152, 'mlockall', 'other'),
('i386', 153, 'munlockall', 'other'),
('i386', 154, 'sched_setparam', 'other'),
('i386', 155, 'sched_getparam', 'other'),
('i386', 156, 'sched_setscheduler', 'other'),
('i386', 157, 'sched_getscheduler', 'other'),
('i386', 158, 'sched_yield', 'other'),
('i386', 159, 'sched_get_priority_max', 'other'),
('i386', 160, 'sched_get_priority_min', 'other'),
('i386', 161, 'sched_rr_get_interval', 'other'),
('i386', 162, 'nanosleep', 'other'),
('i386', 163, 'mremap', 'file'),
('i386', 164, 'setresuid', 'other'),
('i386', 165, 'getresuid', 'other'),
('i386', 166, 'vm86', 'other'),
('i386', 167, 'query_module', 'other'),
('i386', 168, 'poll', 'other'),
('i386', 169, 'nfsservctl', 'other'),
('i386', 170, 'setresgid', 'other'),
('i386', 171, 'getresgid', 'other'),
('i386', 172, 'prctl', 'other'),
('i386', 173, 'rt_sigreturn', 'other'),
('i386', 174, 'rt_sigaction', 'other'),
('i386', 175, 'rt_sigprocmask', 'other'),
('i386', 176, 'rt_sigpending', 'other'),
('i386', 177, 'rt_sigtimedwait', 'other'),
('i386', 178, 'rt_sigqueueinfo', 'other'),
('i386', 179, 'rt_sigsuspend', 'other'),
('i386', 180, 'pread64', 'file'),
('i386', 181, 'pwrite64', 'file'),
('i386', 182, 'chown', 'file'),
('i386', 183, 'getcwd', 'file-meta'),
('i386', 184, 'capget', 'other'),
('i386', 185, 'capset', 'other'),
('i386', 186, 'sigaltstack', 'other'),
('i386', 187, 'sendfile', 'file'),
('i386', 188, 'getpmsg', 'other'),
('i386', 189, 'putpmsg', 'other'),
('i386', 190, 'vfork', 'other'),
('i386', 191, 'ugetrlimit', 'other'),
('i386', 192, 'mmap2', 'file'),
('i386', 193, 'truncate64', 'other'),
('i386', 194, 'ftruncate64', 'other'),
('i386', 195, 'stat64', 'other'),
('i386', 196, 'lstat64', 'other'),
('i386', 197, 'fstat64', 'other'),
('i386', 198, 'lchown32', 'other'),
('i386', 199, 'getuid32', 'other'),
('i386', 200, 'getgid32', 'other'),
('i386', 201, 'geteuid32', 'other'),
('i386', 202, 'getegid32', 'other'),
('i386', 203, 'setreuid32', 'other'),
('i386', 204, 'setregid32', 'other'),
('i386', 205, 'getgroups32', 'other'),
('i386', 206, 'setgroups32', 'other'),
('i386', 207, 'fchown32', 'other'),
('i386', 208, 'setresuid32', 'other'),
('i386', 209, 'getresuid32', 'other'),
('i386', 210, 'setresgid32', 'other'),
('i386', 211, 'getresgid32', 'other'),
('i386', 212, 'chown32', 'other'),
('i386', 213, 'setuid32', 'other'),
('i386', 214, 'setgid32', 'other'),
('i386', 215, 'setfsuid32', 'other'),
('i386', 216, 'setfsgid32', 'other'),
('i386', 217, 'pivot_root', 'other'),
('i386', 218, 'mincore', 'other'),
('i386', 219, 'madvise', 'other'),
('i386', 220, 'getdents64', 'file-meta'),
('i386', 221, 'fcntl64', 'file-meta'),
('i386', 224, 'gettid', 'other'),
('i386', 225, 'readahead', 'other'),
('i386', 226, 'setxattr', 'file'),
('i386', 227, 'lsetxattr', 'file'),
('i386', 228, 'fsetxattr', 'file'),
('i386', 229, 'getxattr', 'other'),
('i386', 230, 'lgetxattr', 'other'),
('i386', 231, 'fgetxattr', 'other'),
('i386', 232, 'listxattr', 'other'),
('i386', 233, 'llistxattr', 'other'),
('i386', 234, 'flistxattr', 'other'),
('i386', 235, 'removexattr', 'file'),
('i386', 236, 'lremovexattr', 'file'),
('i386', 237, 'fremovexattr', 'file'),
('i386', 238, 'tkill', 'other'),
('i386', 239, 'sendfile64', 'other'),
('i386', 240, 'futex', 'other'),
('i386', 241, 'sched_setaffinity', 'other'),
('i386', 242, 'sched_getaffinity', 'other'),
('i386', 243, 'set_thread_area', 'other'),
('i386', 244, 'get_thread_area', 'other'),
('i386', 245, 'io_setup', 'other'),
('i386', 246, 'io_destroy', 'other'),
('i386', 247, 'io_getevents', 'other'),
('i386', 248, 'io_submit', 'other'),
('i386', 249, 'io_cancel', 'other'),
('i386', 250, 'fadvise64', 'other'),
('i386', 252, 'exit_group', 'other'),
('i386', 253, 'lookup_dcookie', 'other'),
('i386', 254, 'epoll_create', 'other'),
('i386', 255, 'epoll_ctl', 'other'),
('i386', 256, 'epoll_wait', 'other'),
('i386', 257, 'remap_file_pages', 'other'),
('i386', 258, 'set_tid_address', 'other'),
('i386', 259, 'timer_create', 'other'),
('i386', 260, 'timer_settime', 'other'),
('i386', 261, 'timer_gettime', 'other'),
('i386', 262, 'timer_getoverrun', 'other'),
('i386', 263, 'timer_delete', 'other'),
('i386', 264, 'clock_settime', 'other'),
('i386', 265, 'clock_gettime', 'other'),
('i386', 266, 'clock_getres', 'other'),
('i386', 267, 'clock_nanosleep', 'other'),
('i386', 268, 'statfs64', 'other'),
('i386', 269, 'fstatfs64', 'other'),
('i386', 270, 'tgkill', 'other'),
('i386', 271, 'utimes', 'file-meta'),
('i386', 272, 'fadvise64_64', 'other'),
('i386', 273, 'vserver', 'other'),
('i386', 274, 'mbind', 'other'),
('i386', 275, 'get_mempolicy', 'other'),
('i386', 276, 'set_mempolicy', 'other'),
('i386', 277, 'mq_open', 'other'),
('i386', 278, 'mq_unlink', 'other'),
('i386', 279, 'mq_timedsend', 'other'),
('i386', 280, 'mq_timedreceive', 'other'),
('i386', 281, 'mq_notify', 'other'),
('i386', 282, 'mq_getsetattr', 'other'),
('i386', 283, 'kexec_load', 'other'),
('i386', 284, 'waitid', 'other'),
('i386', 286, 'add_key', 'other'),
('i386', 287, 'request_key', 'other'),
('i386', 288, 'keyctl', 'other'),
('i386', 289, 'ioprio_set', 'other'),
('i386', 290, 'ioprio_get', 'other'),
('i386', 291, 'inotify_init', 'other'),
('i386', 292, 'inotify_add_watch', 'other'),
('i386', 293, 'inotify_rm_watch', 'other'),
('i386', 294, 'migrate_pages', 'other'),
('i386', 295, 'openat', 'file'),
('i386', 296, 'mkdirat', 'file'),
('i386', 297, 'mknodat', 'file'),
('i386', 298, 'fchownat', 'file'),
('i386', 299, 'futimesat', 'file-meta'),
('i386', 300, 'fstatat64', 'other'),
('i386', 301, 'unlinkat', 'file'),
('i386', 302, 'renameat', 'file'),
('i386', 303, 'linkat', 'file'),
('i386', 304, 'symlinkat', 'file'),
('i386', 305, 'readlinkat', 'file-meta'),
('i386', 306, 'fchmodat', 'file'),
('i386', 307, 'faccessat', 'file-meta'),
('i386', 308, 'pselect6', 'other'),
('i386', 309, 'ppoll', 'other'),
('i386', 310, 'unshare', 'other'),
('i386', 311, 'set_robust_list', 'other'),
('i386', 312, 'get_robust_list', 'other'),
('i386', 313, 'splice', 'file'),
('i386', 314, 'sync_file_range', 'other'),
('i386', 315, 'tee', 'file'),
('i386', 316, 'vmsplice', 'file'),
('i386', 317, 'move_pages', 'other'),
('i386', 318, 'getcpu', 'other'),
('i386', 319, 'epoll_pwait', 'other'),
('i386', 320, 'utimensat', 'file-meta'),
('i386', 321, 'signalfd', 'other'),
('i386', 322, 'timerfd_create', 'other'),
('i386', 323, 'eventfd', 'other'),
('i386', 324, 'fallocate', 'file'),
('i386', 325, 'timerfd_settime', 'other'),
('i386', 326, 'timerfd_gettime', 'other'),
('i386', 327, 'signalfd4', 'other'),
('i386', 328, 'eventfd2', 'other'),
('i386', 329, 'epoll_create1', 'other'),
('i386', 330, 'dup3', 'file-meta'),
('i386', 331, 'pipe2', 'other'),
('i386', 332, 'inotify_init1', 'other'),
('i386', 333, 'preadv', 'file'),
('i386', 334, 'pwritev', 'file'),
('i386', 335, 'rt_tgsigqueueinfo', 'other'),
('i386', 336, 'perf_event_open', 'other'),
('i386', 337, 'recvmmsg', 'net-recv'),
('i386', 338, 'fanotify_init', 'other'),
('i386', 339, 'fanotify_mark', 'other'),
('i386', 340, 'prlimit64', 'other'),
('i386', 341, 'name_to_handle_at', 'other'),
('i386', 342, 'open_by_handle_at', 'other'),
('i386', 343, 'clock_adjtime', 'other'),
('i386', 344, 'syncfs', 'file-meta'),
('i386', 345, 'sendmmsg', 'net-send'),
('i386', 346, 'setns', 'other'),
('i386', 347, 'process_vm_readv', 'other'),
('i386', 348, 'process_vm_writev', 'other'),
('i386', 349, 'kcmp', 'other'),
('i386', 350, 'finit_module', 'other'),
('i386', 351, 'sched_setattr', 'other'),
('i386', 352, 'sched_getattr', 'other'),
('i386', 353, 'renameat2', 'file'),
('i386', 354, 'seccomp', 'other'),
('i386', 355, 'getrandom', 'other'),
('i386', 356, 'memfd_create', 'other'),
('i386', 357, 'bpf', 'other'),
('i386', 358, 'execveat', 'exec'),
('i386', 359, 'socket', 'socket'),
('i386', 360, 'socketpair', 'socket'),
('i386', 361, 'bind', 'socket'),
('i386', 362, 'connect', 'net-connect'),
('i386', 363, 'listen', 'socket'),
('i386', 364, 'accept4', 'net-accept'),
('i386', 365, 'getsockopt', 'socket'),
('i386', 366, 'setsockopt', 'socket'),
('i386', 367, 'getsockname', 'socket'),
('i386', 368, 'getpeername', 'socket'),
('i386', 369, 'sendto', 'net-send'),
('i386', 370, 'sendmsg', 'net-send'),
('i386', 371, 'recvfrom', 'net-recv'),
('i386', 372, 'recvmsg', 'net-recv'),
('i386', 373, 'shutdown', 'socket'),
('i386', 374, 'userfaultfd', 'other'),
('i386', 375, 'membarrier', 'other'),
('i386', 376, 'mlock2', 'other'),
('i386', 377, 'copy_file_range', 'file'),
('i386', 378, 'preadv2', 'file'),
('i386', 379, 'pwritev2', 'file'),
('i386', 380, 'pkey_mprotect', 'other'),
('i386', 381, 'pkey_alloc', 'other'),
('i386', 382, 'pkey_free', 'other'),
('i386', 383, 'statx', 'file-meta'),
('i386', 384, 'arch_prctl', 'other'),
('i386', 385, 'io_pgetevents', 'other'),
('i386', 386, 'rseq', 'other'),
('i386', 393, 'semget', 'other'),
('i386', 394, 'semctl', 'other'),
('i386', 395, 'shmget', 'file'),
('i386', 396, 'shmctl', 'other'),
('i386', 397, 'shmat', 'file'),
('i386', 398, 'shmdt', 'other'),
('i386', 399, 'msgget', 'other'),
('i386', 400, 'msgsnd', 'other'),
('i386', 401, 'msgrcv', 'other'),
('i386', 402, 'msgctl', 'other'),
('i386', 403, 'clock_gettime64', 'other'),
('i386', 404, 'clock_settime64', 'other'),
('i386', 405, 'clock_adjtime64', 'other'),
('i386', 406, 'clock_getres_time64', 'other'),
('i386', 407, 'clock_nanosleep_time64', 'other'),
('i386', 408, 'timer_gettime64', 'other'),
('i386', 409, 'timer_settime64', 'other'),
('i386', 410, 'timerfd_gettime64', 'other'),
('i386', 411, 'timerfd_settime64', 'other'),
('i386', 412, 'utimensat_time64', 'other'),
('i386', 413, 'pselect6_time64', 'other'),
('i386', 414, 'ppoll_time64', 'other'),
('i386', 416, 'io_pgetevents_time64', 'other'),
('i386', 417, 'recvmmsg_time64', 'other'),
('i386', 418, 'mq_timedsend_time64', 'other'),
('i386', 419, 'mq_timedreceive_time64', 'other'),
('i386', 420, 'semtimedop_time64', 'other'),
('i386', 421, 'rt_sigtimedwait_time64', 'other'),
('i386', 422, 'futex_time64', 'other'),
('i386', 423, 'sched_rr_get_interval_time64', 'other'),
('i386', 424, 'pidfd_send_signal', 'other'),
('i386', 425, 'io_uring_setup', 'other'),
('i386', 426, 'io_uring_enter', 'other'),
('i386', 427, 'io_uring_register', 'other'),
('i386', 428, 'open_tree', 'other'),
('i386', 429, 'move_mount', 'other'),
('i386', 430, 'fsopen', 'other'),
('i386', 431, 'fsconfig', 'other'),
('i386', 432, 'fsmount', 'other'),
('i386', 433, 'fspick', 'other'),
('i386', 434, 'pidfd_open', 'other'),
('i386', 435, 'clone3', 'other'),
('i386', 436, 'close_range', 'other'),
('i386', 437, 'openat2', 'file'),
('i386', 438, 'pidfd_getfd', 'other'),
('i386', 439, 'faccessat2', 'file-meta'),
('i386', 440, 'process_madvise', 'other'),
('i386', 441, 'epoll_pwait2', 'other'),
('i386', 442, 'mount_setattr', 'other'),
('i386', 443, 'quotactl_fd', 'other'),
('i386', 444, 'landlock_create_ruleset', 'other'),
('i386', 445, 'landlock_add_rule', 'other'),
('i386', 446, 'landlock_restrict_self', 'other'),
('i386', 447, 'memfd_secret', 'other'),
('i386', 448, 'process_mrelease', 'other'),
('i386', 449, 'futex_waitv', 'other'),
('i386', 450, 'set_mempolicy_home_node', 'other'),
('i386', 451, 'cachestat', 'other'),
('i386', 452, 'fchmodat2', 'other'),
('i386', 453, 'map_shadow_stack', 'other'),
('i386', 454, 'futex_wake', 'other'),
('i386', 455, 'futex_wait', 'other'),
('i386', 456, 'futex_requeue', 'other'),
('i386', 457, 'statmount', 'other'),
('i386', 458, 'listmount', 'other'),
('i386', 459, 'lsm_get_self_attr', 'other'),
('i386', 460, 'lsm_set_self_attr', 'other'),
('i386', 461, 'lsm_list_modules', 'other'),
('i386', 462, 'mseal', 'other'),
('aarch64', 0, 'io_setup', 'other'),
('aarch64', 1, 'io_destroy', 'other'),
('aarch64', 2, 'io_submit', 'other'),
('aarch64', 3, 'io_cancel', 'other'),
('aarch64', 4, 'io_getevents', 'other'),
('aarch64', 5, 'setxattr', 'file'),
('aarch64', 6, 'lsetxattr', 'file'),
('aarch64', 7, 'fsetxattr', 'file'),
('aarch64', 8, 'getxattr', 'other'),
('aarch64', 9, 'lgetxattr', 'other'),
('aarch64', 10, 'fgetxattr', 'other'),
('aarch64', 11, 'listxattr', 'other'),
('aarch64', 12, 'llistxattr', 'other'),
('aarch64', 13, 'flistxattr', 'other'),
('aarch64', 14, 'removexattr', 'file'),
('aarch64', 15, 'lremovexattr', 'file'),
('aarch64', 16, 'fremovexattr', 'file'),
('aarch64', 17, 'getcwd', 'file-meta'),
('aarch64', 18, 'lookup_dcookie', 'other'),
('aarch64', 19, 'eventfd2', 'other'),
('aarch64', 20, 'epoll_create1', 'other'),
('aarch64', 21, 'epoll_ctl', 'other'),
('aarch64', 22, 'epoll_pwait', 'other'),
('aarch64', 23, 'dup', 'file-meta'),
('aarch64', 24, 'dup3', 'file-meta'),
('aarch64', 26, 'inotify_init1', 'other'),
('aarch64', 27, 'inotify_add_watch', 'other'),
('aarch64', 28, 'inotify_rm_watch', 'other'),
('aarch64', 29, 'ioctl', 'file-meta'),
('aarch64', 30, 'ioprio_set', 'other'),
('aarch64', 31, 'ioprio_get', 'other'),
('aarch64', 32, 'flock', 'file-meta'),
('aarch64', 33, 'mknodat', 'file'),
('aarch64', 34, 'mkdirat', 'file'),
('aarch64', 35, 'unlinkat', 'file'),
('aarch64', 36, 'symlinkat', 'file'),
('aarch64', 37, 'linkat', 'file'),
('aarch64', 38, 'renameat', 'file'),
('aarch64', 39, 'umount2', 'other'),
('aarch64', 40, 'mount', 'other'),
('aarch64', 41, 'pivot_root', 'other'),
('aarch64', 42, 'nfsservctl', 'other'),
('aarch64', 47, 'fallocate', 'file'),
('aarch64', 48, 'faccessat', 'file-meta'),
('aarch64', 49, 'chdir', 'file-meta'),
('aarch64', 50, 'fchdir', 'file-meta'),
('aarch64', 51, 'chroot', 'other'),
('aarch64', 52, 'fchmod', 'file'),
('aarch64', 53, 'fchmodat', 'file'),
('aarch64', 54, 'fchownat', 'file'),
('aarch64', 55, 'fchown', 'file'),
('aarch64', 56, 'openat', 'file'),
('aarch64', 57, 'close', 'file'),
('aarch64', 58, 'vhangup', 'other'),
('aarch64', 59, 'pipe2', 'other'),
('aarch64', 60, 'quotactl', 'other'),
('aarch64', 61, 'getdents64', 'file-meta'),
('aarch64', 63, 'read', 'file'),
('aarch64', 64, 'write', 'file'),
('aarch64', 65, 'readv', 'file'),
('aarch64', 66, 'writev', 'file'),
('aarch64', 67, 'pread64', 'file'),
('aarch64', 68, 'pwrite64', 'file'),
('aarch64', 69, 'preadv', 'file'),
('aarch64', 70, 'pwritev', 'file'),
('aarch64', 72, 'pselect6', 'other'),
('aarch64', 73, 'ppoll', 'other'),
('aarch64', 74, 'signalfd4', 'other'),
('aarch64', 75, 'vmsplice', 'file'),
('aarch64', 76, 'splice', 'file'),
('aarch64', 77, 'tee', 'file'),
('aarch64', 78, 'readlinkat', 'file-meta'),
('aarch64', 81, 'sync', 'file-meta'),
('aarch64', 82, 'fsync', 'file-meta'),
('aarch64', 83, 'fdatasync', 'file-meta'),
('aarch64', 84, 'sync_file_range2', 'other'),
('aarch64', 85, 'timerfd_create', 'other'),
('aarch64', 86, 'timerfd_settime', 'other'),
('aarch64', 87, 'timerfd_gettime', 'other'),
('aarch64', 88, 'utimensat', 'file-meta'),
('aarch64', 89, 'acct', 'other'),
('aarch64', 90, 'capget', 'other'),
('aarch64', 91, 'capset', 'other'),
('aarch64', 92, 'personality', 'other'),
('aarch64', 93, 'exit', 'other'),
('aarch64', 94, 'exit_group', 'other'),
('aarch64', 95, 'waitid', 'other'),
('aarch64', 96, 'set_tid_address', 'other'),
('aarch64', 97, 'unshare', 'other'),
('aarch64', 98, 'futex', 'other'),
('aarch64', 99, 'set_robust_list', 'other'),
('aarch64', 100, 'get_robust_list', 'other'),
('aarch64', 101, 'nanosleep', 'other'),
('aarch64', 102, 'getitimer', 'other'),
('aarch64', 103, 'setitimer', 'other'),
('aarch64', 104, 'kexec_load', 'other'),
('aarch64', 105, 'init_module', 'other'),
('aarch64', 106, 'delete_module', 'other'),
('aarch64', 107, 'timer_create', 'other'),
('aarch64', 108, 'timer_gettime', 'other'),
('aarch64', 109, 'timer_getoverrun', 'other'),
('aarch64', 110, 'timer_settime', 'other'),
('aarch64', 111, 'timer_delete', 'other'),
('aarch64', 112, 'clock_settime', 'other'),
('aarch64', 113, 'clock_gettime', 'other'),
('aarch64', 114, 'clock_getres', 'other'),
('aarch64', 115, 'clock_nanosleep', 'other'),
('aarch64', 116, 'syslog', 'other'),
('aarch64', 117, 'ptrace', 'other'),
('aarch64', 118, 'sched_setparam', 'other'),
('aarch64', 119, 'sched_setscheduler', 'other'),
('aarch64', 120, 'sched_getscheduler', 'other'),
('aarch64', 121, 'sched_getparam', 'other'),
('aarch64', 122, 'sched_setaffinity', 'other'),
('aarch64', 123, 'sched_getaffinity', 'other'),
('aarch64', 124, 'sched_yield', 'other'),
('aarch64', 125, 'sched_get_priority_max', 'other'),
('aarch64', 126, 'sched_get_priority_min', 'other'),
('aarch64', 127, 'sched_rr_get_interval', 'other'),
('aarch64', 128, 'restart_syscall', 'other'),
('aarch64', 129, 'kill', 'other'),
('aarch64', 130, 'tkill', 'other'),
('aarch64', 131, 'tgkill', 'other'),
('aarch64', 132, 'sigaltstack', 'other'),
('aarch64', 133, 'rt_sigsuspend', 'other'),
('aarch64', 134, 'rt_sigaction', 'other'),
('aarch64', 135, 'rt_sigprocmask', 'other'),
('aarch64', 136, 'rt_sigpending', 'other'),
('aarch64', 137, 'rt_sigtimedwait', 'other'),
('aarch64', 138, 'rt_sigqueueinfo', 'other'),
('aarch64', 139, 'rt_sigreturn', 'other'),
('aarch64', 140, 'setpriority', 'other'),
('aarch64', 141, 'getpriority', 'other'),
('aarch64', 142, 'reboot', 'other'),
('aarch64', 143, 'setregid', 'other'),
('aarch64', 144, 'setgid', 'other'),
('aarch64', 145, 'setreuid', 'other'),
('aarch64', 146, 'setuid', 'other'),
('aarch64', 147, 'setresuid', 'other'),
('aarch64', 148, 'getresuid', 'other'),
('aarch64', 149, 'setresgid', 'other'),
('aarch64', 150, 'getresgid', 'other'),
('aarch64', 151, 'setfsuid', 'other'),
('aarch64', 152, 'setfsgid', 'other'),
('aarch64', 153, 'times', 'other'),
('aarch64', 154, 'setpgid', 'other'),
('aarch64', 155, 'getpgid', 'other'),
('aarch64', 156, 'getsid', 'other'),
('aarch64', 157, 'setsid', 'other'),
('aarch64', 158, 'getgroups', 'other'),
('aarch64', 159, 'setgroups', 'other'),
('aarch64', 160, 'uname', 'other'),
('aarch64', 161, 'sethostname', 'other'),
('aarch64', 162, 'setdomainname', 'other'),
('aarch64', 163, 'getrlimit', 'other'),
('aarch64', 164, 'setrlimit', 'other'),
('aarch64', 165, 'getrusage', 'other'),
('aarch64', 166, 'umask', 'file-meta'),
('aarch64', 167, 'prctl', 'other'),
('aarch64', 168, 'getcpu', 'other'),
('aarch64', 169, 'gettimeofday', 'other'),
('aarch64', 170, 'settimeofday', 'other'),
('aarch64', 171, 'adjtimex', 'other'),
('aarch64', 172, 'getpid', 'other'),
('aarch64', 173, 'getppid', 'other'),
('aarch64', 174, 'getuid', 'other'),
('aarch64', 175, 'geteuid', 'other'),
('aarch64', 176, 'getgid', 'other'),
('aarch64', 177, 'getegid', 'other'),
('aarch64', 178, 'gettid', 'other'),
('aarch64', 179, 'sysinfo', 'other'),
('aarch64', 180, 'mq_open', 'other'),
('aarch64', 181, 'mq_unlink', 'other'),
('aarch64', 182, 'mq_timedsend', 'other'),
('aarch64', 183, 'mq_timedreceive', 'other'),
('aarch64', 184, 'mq_notify', 'other'),
('aarch64', 185, 'mq_getsetattr', 'other'),
('aarch64', 186, 'msgget', 'other'),
('aarch64', 187, 'msgctl', 'other'),
('aarch64', 188, 'msgrcv', 'other'),
('aarch64', 189, 'msgsnd', 'other'),
('aarch64', 190, 'semget', 'other'),
('aarch64', 191, 'semctl', 'other'),
('aarch64', 192, 'semtimedop', 'other'),
('aarch64', 193, 'semop', 'other'),
('aarch64', 194, 'shmget', 'file'),
('aarch64', 195, 'shmctl', 'other'),
('aarch64', 196, 'shmat', 'file'),
('aarch64', 197, 'shmdt', 'other'),
('aarch64', 198, 'socket', 'socket'),
('aarch64', 199, 'socketpair', 'socket'),
('aarch64', 200, 'bind', 'socket'),
('aarch64', 201, 'listen', 'socket'),
('aarch64', 202, 'accept', 'net-accept'),
('aarch64', 203, 'connect', 'net-connect'),
('aarch64', 204, 'getsockname', 'socket'),
('aarch64', 205, 'getpeername', 'socket'),
('aarch64', 206, 'sendto', 'net-send'),
('aarch64', 207, 'recvfrom', 'net-recv'),
('aarch64', 208, 'setsockopt', 'socket'),
('aarch64', 209, 'getsockopt', 'socket'),
('aarch64', 210, 'shutdown', 'socket'),
('aarch64', 211, 'sendmsg', 'net-send'),
('aarch64', 212, 'recvmsg', 'net-recv'),
('aarch64', 213, 'readahead', 'other'),
('aarch64', 214, 'brk', 'other'),
('aarch64', 215, 'munmap', 'other'),
('aarch64', 216, 'mremap', 'file'),
('aarch64', 217, 'add_key', 'other'),
('aarch64', 218, 'request_key', 'other'),
('aarch64', 219, 'keyctl', 'other'),
('aarch64', 220, 'clone', 'other'),
('aarch64', 221, 'execve', 'exec'),
('aarch64', 224, 'swapon', 'other'),
('aarch64', 225, 'swapoff', 'other'),
('aarch64', 226, 'mprotect', 'other'),
('aarch64', 227, 'msync', 'file'),
('aarch64', 228, 'mlock', 'other'),
('aarch64', 229, 'munlock', 'other'),
('aarch64', 230, 'mlockall', 'other'),
('aarch64', 231, 'munlockall', 'other'),
('aarch64', 232, 'mincore', 'other'),
('aarch64', 233, 'madvise', 'other'),
('aarch64', 234, 'remap_file_pages', 'other'),
('aarch64', 235, 'mbind', 'other'),
('aarch64', 236, 'get_mempolicy', 'other'),
('aarch64', 237, 'set_mempolicy', 'other'),
('aarch64', 238, 'migrate_pages', 'other'),
('aarch64', 239, 'move_pages', 'other'),
('aarch64', 240, 'rt_tgsigqueueinfo', 'other'),
('aarch64', 241, 'perf_event_open', 'other'),
('aarch64', 242, 'accept4', 'net-accept'),
('aarch64', 243, 'recvmmsg', 'net-recv'),
('aarch64', 260, 'wait4', 'other'),
('aarch64', 261, 'prlimit64', 'other'),
('aarch64', 262, 'fanotify_init', 'other'),
('aarch64', 263, 'fanotify_mark', 'other'),
('aarch64', 264, 'name_to_handle_at', 'other'),
('aarch64', 265, 'open_by_handle_at', 'other'),
('aarch64', 266, 'clock_adjtime', 'other'),
('aarch64', 267, 'syncfs', 'file-meta'),
('aarch64', 268, 'setns', 'other'),
('aarch64', 269, 'sendmmsg', 'net-send'),
('aarch64', 270, 'process_vm_readv', 'other'),
('aarch64', 271, 'process_vm_writev', 'other'),
('aarch64', 272, 'kcmp', 'other'),
('aarch64', 273, 'finit_module', 'other'),
('aarch64', 274, 'sched_setattr', 'other'),
('aarch64', 275, 'sched_getattr', 'other'),
('aarch64', 276, 'renameat2', 'file'),
('aarch64', 277, 'seccomp', 'other'),
('aarch64', 278, 'getrandom', 'other'),
('aarch64', 279, 'memfd_create', 'other'),
('aarch64', 280, 'bpf', 'other'),
('aarch64', 281, 'execveat', 'exec'),
('aarch64', 282, 'userfaultfd', 'other'),
('aarch64', 283, 'membarrier', 'other'),
('aarch64', 284, 'mlock2', 'other'),
('aarch64', 285, 'copy_file_range', 'file'),
('aarch64', 286, 'preadv2', 'file'),
('aarch64', 287, 'pwritev2', 'file'),
('aarch64', 288, 'pkey_mprotect', 'other'),
('aarch64', 289, 'pkey_alloc', 'other'),
('aarch64', 290, 'pkey_free', 'other'),
('aarch64', 291, 'statx', 'file-meta'),
('aarch64', 292, 'io_pgetevents', 'other'),
('aarch64', 293, 'rseq', 'other'),
('aarch64', 294, 'kexec_file_load', 'other'),
('aarch64', 403, 'clock_gettime64', 'other'),
('aarch64', 404, 'clock_settime64', 'other'),
('aarch64', 405, 'clock_adjtime64', 'other'),
('aarch64', 406, 'clock_getres_time64', 'other'),
('aarch64', 407, 'clock_nanosleep_time64', 'other'),
('aarch64', 408, 'timer_gettime64', 'other'),
('aarch64', 409, 'timer_settime64', 'other'),
('aarch64', 410, 'timerfd_gettime64', 'other'),
('aarch64', 411, 'timerfd_settime64', 'other'),
('aarch64', 412, 'utimensat_time64', 'other'),
('aarch64', 413, 'pselect6_time64', 'other'),
('aarch64', 414, 'ppoll_time64', 'other'),
('aarch64', 416, 'io_pgetevents_time64', 'other'),
('aarch64', 417, 'recvmmsg_time64', 'other'),
('aarch64', 418, 'mq_timedsend_time64', 'other'),
('aarch64', 419, 'mq_timedreceive_time64', 'other'),
('aarch64', 420, 'semtimedop_time64', 'other'),
('aarch64', 421, 'rt_sigtimedwait_time64', 'other'),
('aarch64', 422, 'futex_time64', 'other'),
('aarch64', 423, 'sched_rr_get_interval_time64', 'other'),
('aarch64', 424, 'pidfd_send_signal', 'other'),
('aarch64', 425, 'io_uring_setup', 'other'),
('aarch64', 426, 'io_uring_enter', 'other'),
('aarch64', 427, 'io_uring_register', 'other'),
('aarch64', 428, 'open_tree', 'other'),
('aarch64', 429, 'move_mount', 'other'),
('aarch64', 430, 'fsopen', 'other'),
('aarch64', 431, 'fsconfig', 'other'),
('aarch64', 432, 'fsmount', 'other'),
('aarch64', 433, 'fspick', 'other'),
('aarch64', 434, 'pidfd_open', 'other'),
('aarch64', 435, 'clone3', 'other'),
('aarch64', 436, 'close_range', 'other'),
('aarch64', 437, 'openat2', 'file'),
('aarch64', 438, 'pidfd_getfd', 'other'),
('aarch64', 439, 'faccessat2', 'file-meta'),
('aarch64', 440, 'process_madvise', 'other'),
('aarch64', 441, 'epoll_pwait2', 'other'),
('aarch64', 442, 'mount_setattr', 'other'),
('aarch64', 443, 'quotactl_fd', 'other'),
('aarch64', 444, 'landlock_create_ruleset', 'other'),
('aarch64', 445, 'landlock_add_rule', 'other'),
('aarch64', 446, 'landlock_restrict_self', 'other'),
('aarch64', 447, 'memfd_secret', 'other'),
('aarch64', 448, 'process_mrelease', 'other'),
('aarch64', 449, 'futex_waitv', 'other'),
('aarch64', 450, 'set_mempolicy_home_node', 'other'),
('aarch64', 451, 'cachestat', 'other'),
('aarch64', 452, 'fchmodat2', 'other'),
('aarch64', 453, 'map_shadow_stack', 'other'),
('aarch64', 454, 'futex_wake', 'other'),
('aarch64', 455, 'futex_wait', 'other'),
('aarch64', 456, 'futex_requeue', 'other'),
('aarch64', 457, 'statmount', 'other'),
('aarch64', 458, 'listmount', 'other'),
('aarch64', 459, 'lsm_get_self_attr', 'other'),
('aarch64', 460, 'lsm_set_self_attr', 'other'),
('aarch64', 461, 'lsm_list_modules', 'other'),
('aarch64', 462, 'mseal', 'other')
"""

# Parts of sensitive paths, and prefixes of paths that are noise.
SENSITIVE = [
    ".aws/credentials", ".config/gcloud", ".azure/", ".kube/config", "/.ssh/", "id_rsa", "id_ed25519", "id_ecdsa", ".ssh/authorized_keys", ".gnupg", ".kdbx", ".env",
    ".bash_history", ".mysql_history", "/etc/shadow", "/etc/passwd", "/etc/sudoers", "/etc/cron", "/etc/systemd/system", "cookies", "login-data", ".p12", ".pfx",
]
NOISE = [
    "/proc/", "/sys/", "/dev/", "/run/", "/var/run/", "/tmp/.X11-unix/", "/usr/lib/locale/", "/etc/ld.so.cache", "/usr/lib/", "/lib/", "/usr/share/",
]
# Dangerous commands, as (pattern, label), and programs.
DANGER_PATTERNS = [
    (r"(?:^|[;|&]\s*|\b(?:sudo|xargs|env)\s+|\s-c\s+)rm\s+(?:-\S+\s+)*(?:-[a-zA-Z]*r|--recursive\b)", "recursive rm"),
    (r"(?:^|[;|&]\s*|\b(?:sudo|xargs|env)\s+|\s-c\s+)(?:useradd|userdel|usermod|groupadd|passwd|chpasswd)\b", "account/password change"),
    (r"\bmkfs(?:\.\w+)?\s", "filesystem format"),
    (r"\bdd\s[^|;&]*\bof=/dev/(?:sd|nvme|vd|hd|mmcblk)", "dd to raw disk"),
    (r"(?:curl|wget|fetch)\s[^|]*\|\s*(?:sudo\s+)?(?:sh|bash|zsh|python[0-9.]*|perl|ruby)(?:\s|$)", "pipe download to interpreter"),
    (r"\b(?:base64|xxd|openssl enc)\b[^|]*\|\s*(?:sh|bash)(?:\s|$)", "decode then execute"),
    (r"/dev/(?:tcp|udp)/[\w.\-]+/\d+", "shell network socket"),
    (r"\b(?:nc|ncat|netcat)\s[^|;]*\s-[a-zA-Z]*e[a-zA-Z]*\s", "netcat with -e"),
    (r"/etc/sudoers\b", "sudoers change"),
    (r"/etc/(?:shadow|gshadow)\b", "credential file access"),
    (r"\bauthorized_keys\b", "authorized_keys change"),
    (r"\bsetenforce\s+0\b|\bselinux=0\b|\benforcing=0\b", "SELinux disabled"),
    (r"\b(?:iptables|ip6tables)\s[^|;]*?(?:-F\b|--flush\b)|\bnft\s+flush\b", "firewall flush"),
    (r"\bauditctl\s+-e\s*0\b|\bpkill\s+\S*auditd\b|\bservice\s+auditd\s+stop\b", "auditd disabled"),
    (r"\bauditctl\b", "audit config change"),
    (r"/etc/audit\b", "audit config file touched"),
    (r"\bhistory\s+-c\b|\bunset\s+HISTFILE\b|>\s*\S*\.bash_history\b", "shell history cleared"),
    (r"(?:>|truncate\s[^;|]*|rm\s[^;|]*)\s*/var/log/", "log files wiped"),
    (r"\bcrontab\s+-r\b", "crontab removed"),
    (r"\bsudo\s+(?:-i|-s|su|bash|sh)(?:\s|$)|\bsudo\s+-u\s+root\s+(?:sh|bash)\b", "root shell via sudo"),
    (r"\b(?:tar|zip|7z)\b[^|;]*\s(?:.*)(?:\.aws|\.ssh|/etc/|\.kube|\.gnupg)", "archive of sensitive scope"),
]
DANGER_PROGRAMS = {
    "shred": "secure file wipe",
    "wipefs": "disk signature wipe",
    "blkdiscard": "disk discard",
    "useradd": "user/group change",
    "userdel": "user/group change",
    "usermod": "user/group change",
    "groupadd": "user/group change",
    "groupdel": "user/group change",
    "passwd": "password change",
    "chpasswd": "password change",
    "visudo": "sudoers change",
    "setenforce": "SELinux mode change",
    "insmod": "kernel module insert",
    "auditctl": "audit config change",
}
# Titles and severities of rules.
TITLES = {
    "LT001": ("Reverse shell pattern in command line", 4),
    "LT002": ("Privilege escalation attempt (sudo/su from non-root session)", 3),
    "LT003": ("User account created", 3),
    "LT004": ("SSH key material accessed", 2),
    "LT005": ("Cloud credentials file accessed", 2),
    "LT006": ("Outbound connection to raw IP (no hostname resolution)", 1),
    "LT007": ("Cron/service persistence modified", 3),
    "LT008": ("History/log file truncated (anti-forensics)", 2),
    "LT009": ("Database dump created", 2),
    "LT010": ("Archive of sensitive scope created", 2),
    "ESC-001": ("Privilege escalation attempted and denied", 3),
}
