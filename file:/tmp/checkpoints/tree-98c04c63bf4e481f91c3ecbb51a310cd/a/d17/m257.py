x257