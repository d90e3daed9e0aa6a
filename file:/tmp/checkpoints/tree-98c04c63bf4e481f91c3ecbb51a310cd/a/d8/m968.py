x968