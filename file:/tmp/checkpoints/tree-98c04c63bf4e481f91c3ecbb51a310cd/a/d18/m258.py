x258