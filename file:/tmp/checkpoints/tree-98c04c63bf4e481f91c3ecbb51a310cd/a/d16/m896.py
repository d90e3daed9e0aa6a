x896