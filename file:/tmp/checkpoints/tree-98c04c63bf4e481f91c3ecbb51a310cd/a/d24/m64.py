x64