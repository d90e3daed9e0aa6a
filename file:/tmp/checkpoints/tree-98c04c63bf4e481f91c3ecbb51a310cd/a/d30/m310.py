x310