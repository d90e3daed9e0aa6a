x190