x584