x588