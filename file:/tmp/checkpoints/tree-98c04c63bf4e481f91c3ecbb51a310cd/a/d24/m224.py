x224