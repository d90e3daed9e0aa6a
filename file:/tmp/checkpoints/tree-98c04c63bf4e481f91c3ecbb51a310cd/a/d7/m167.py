x167