x90