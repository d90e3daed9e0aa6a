x86