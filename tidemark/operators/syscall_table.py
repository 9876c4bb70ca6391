"""Numbers of the system calls whose kind matters, one row per call, by table."""

# Numbers and names of the kernel's interface, in order.
X86_64 = """
0 read
1 write
2 open
3 close
4 stat
5 fstat
6 lstat
8 lseek
9 mmap
16 ioctl
17 pread64
18 pwrite64
19 readv
20 writev
21 access
25 mremap
26 msync
29 shmget
30 shmat
32 dup
33 dup2
40 sendfile
41 socket
42 connect
43 accept
44 sendto
45 recvfrom
46 sendmsg
47 recvmsg
48 shutdown
49 bind
50 listen
51 getsockname
52 getpeername
53 socketpair
54 setsockopt
55 getsockopt
59 execve
72 fcntl
73 flock
74 fsync
75 fdatasync
76 truncate
77 ftruncate
78 getdents
79 getcwd
80 chdir
81 fchdir
82 rename
83 mkdir
84 rmdir
85 creat
86 link
87 unlink
88 symlink
89 readlink
90 chmod
91 fchmod
92 chown
93 fchown
94 lchown
95 umask
133 mknod
137 statfs
138 fstatfs
162 sync
188 setxattr
189 lsetxattr
190 fsetxattr
197 removexattr
198 lremovexattr
199 fremovexattr
217 getdents64
235 utimes
257 openat
258 mkdirat
259 mknodat
260 fchownat
261 futimesat
262 newfstatat
263 unlinkat
264 renameat
265 linkat
266 symlinkat
267 readlinkat
268 fchmodat
269 faccessat
275 splice
276 tee
278 vmsplice
280 utimensat
285 fallocate
288 accept4
292 dup3
295 preadv
296 pwritev
299 recvmmsg
306 syncfs
307 sendmmsg
316 renameat2
322 execveat
326 copy_file_range
327 preadv2
328 pwritev2
332 statx
437 openat2
439 faccessat2
"""
I386 = """
3 read
4 write
5 open
6 close
8 creat
9 link
10 unlink
11 execve
12 chdir
14 mknod
15 chmod
16 lchown
19 lseek
33 access
36 sync
38 rename
39 mkdir
40 rmdir
41 dup
54 ioctl
55 fcntl
60 umask
63 dup2
83 symlink
85 readlink
90 mmap
92 truncate
93 ftruncate
94 fchmod
95 fchown
99 statfs
100 fstatfs
106 stat
107 lstat
108 fstat
118 fsync
133 fchdir
141 getdents
143 flock
144 msync
145 readv
146 writev
148 fdatasync
163 mremap
180 pread64
181 pwrite64
182 chown
183 getcwd
187 sendfile
192 mmap2
220 getdents64
221 fcntl64
226 setxattr
227 lsetxattr
228 fsetxattr
235 removexattr
236 lremovexattr
237 fremovexattr
271 utimes
295 openat
296 mkdirat
297 mknodat
298 fchownat
299 futimesat
301 unlinkat
302 renameat
303 linkat
304 symlinkat
305 readlinkat
306 fchmodat
307 faccessat
313 splice
315 tee
316 vmsplice
320 utimensat
324 fallocate
330 dup3
333 preadv
334 pwritev
337 recvmmsg
344 syncfs
345 sendmmsg
353 renameat2
358 execveat
359 socket
360 socketpair
361 bind
362 connect
363 listen
364 accept4
365 getsockopt
366 setsockopt
367 getsockname
368 getpeername
369 sendto
370 sendmsg
371 recvfrom
372 recvmsg
373 shutdown
377 copy_file_range
378 preadv2
379 pwritev2
383 statx
395 shmget
397 shmat
437 openat2
439 faccessat2
"""
AARCH64 = """
5 setxattr
6 lsetxattr
7 fsetxattr
14 removexattr
15 lremovexattr
16 fremovexattr
17 getcwd
23 dup
24 dup3
29 ioctl
32 flock
33 mknodat
34 mkdirat
35 unlinkat
36 symlinkat
37 linkat
38 renameat
47 fallocate
48 faccessat
49 chdir
50 fchdir
52 fchmod
53 fchmodat
54 fchownat
55 fchown
56 openat
57 close
61 getdents64
63 read
64 write
65 readv
66 writev
67 pread64
68 pwrite64
69 preadv
70 pwritev
75 vmsplice
76 splice
77 tee
78 readlinkat
81 sync
82 fsync
83 fdatasync
88 utimensat
166 umask
194 shmget
196 shmat
198 socket
199 socketpair
200 bind
201 listen
202 accept
203 connect
204 getsockname
205 getpeername
206 sendto
207 recvfrom
208 setsockopt
209 getsockopt
210 shutdown
211 sendmsg
212 recvmsg
216 mremap
221 execve
227 msync
242 accept4
243 recvmmsg
267 syncfs
269 sendmmsg
276 renameat2
281 execveat
285 copy_file_range
286 preadv2
287 pwritev2
291 statx
437 openat2
439 faccessat2
"""

TABLES = {"x86_64": X86_64, "i386": I386, "aarch64": AARCH64}
